"""SimHash near-duplicates with covering locality-sensitive hashing (operator 9).

``fingerprints`` adds the 64-bit SimHash of each text. ``link`` groups fingerprints that differ in at most
``RADIUS`` = 2 bits: every bit position carries a non-zero vector of F2^3, and table v keeps the positions
whose vector has an odd product with v. Two fingerprints that differ in at most two positions span less
than the whole space, so some non-zero v is orthogonal to both positions and its table doesn't see the
difference: with 7 tables no such pair is missed. Inside a bucket two members are within two bits exactly
if they share a one-bit neighbour (or are one themselves), so a bucket is linked through those neighbours:
rows grow with members, never with their pairs, and a neighbour has 29 members at most.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; a text of
one or two words is one shingle; a text of any length is read whole; equal texts have equal fingerprints; a component
carries its smallest non-null doc_id; repeated rows repeat their result; an empty table gives an empty table; columns
that clash with the added ones are replaced."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.storage import forget, settled

from .common import add_columns, materialise, read_table, utf8, without

RADIUS = 2
BITS = 64
SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 14
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def covering_masks() -> list[int]:
    """For each non-zero v of F2^3 the bit positions i with odd <m(i), v>, m(i) cycling through 1..7."""
    vectors = [1 + i % 7 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << RADIUS + 1)]


MASKS = covering_masks()


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text: a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    hashed = xxhash.xxh64_digest
    words = text.translate(LOWER).split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) < size:
        return int.from_bytes(hashed(plain, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return folded(np.frombuffer(b"".join([hashed(plain[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]), ">u8"))


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def covering_keys(fp: int) -> np.ndarray:
    """What a fingerprint's tables see of it, told apart by table: two within RADIUS bits share a key."""
    seen = np.array([fp & m for m in MASKS], np.uint64)
    mixed = (seen ^ np.arange(1, len(MASKS) + 1, dtype=np.uint64) * MULTIPLIER) * MULTIPLIER
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp", keep_text: bool = False) -> DataFrame:
    """``df`` with ``out_col`` long: the SimHash bits as a signed integer."""
    make: Callable = lambda: lambda column: [pa.array([signed(simhash(b)) for b in utf8(column)], pa.int64())]
    return add_columns(df, text_col, T.StructType([T.StructField(out_col, T.LongType())]), make, drop_source=not keep_text)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect the fingerprints ``fp`` of ``distinct`` (each once) as all pairs
    within two bits would."""
    masks = MASKS
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    cells = distinct.select("fp", F.inline(tables))
    crowded = cells.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = cells.join(crowded, ["t", "key"], "left_semi")
    free = [[0, *(signed(1 << i) for i in range(BITS) if not m >> i & 1)] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in free]), F.col("t") + 1)
    near = members.select("t", "fp", F.explode(flips).alias("flip")).select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), "fp")
    met = near.groupBy("t", "near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step of alternating stars over edges (a < b)."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(low, "b")
        moved = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b"))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a < b), root its component's smallest node: large and
    small stars alternate until nothing moves; each round is written and replaces the one before. Rounds grow with
    the logarithm of the nodes."""
    spark = edges.sparkSession
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    edges, held = settled(edges, "links")
    before = mark(edges)
    while before[0]:
        edges, path = settled(star(star(edges, True), False), "stars")
        forget(spark, held)
        held, after = path, mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def link(marked: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp) with ``component_id``, the smallest doc_id reachable over links, and
    ``_root``, the component's smallest fingerprint; columns of those names are replaced."""
    marked = without(marked, ["component_id", "_root"])
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = components(links(distinct.select("fp")))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.where("root <> fp").groupBy("root").agg(F.min("low").alias("other"))
    named = rooted.join(least, "root", "left").select("fp", F.least("low", "other").alias("own"), "root")
    heads = named.where("root = fp").select("root", F.col("own").alias("component_id"))
    others = named.where("root <> fp").select("fp", "root").join(heads, "root")
    lookup = others.unionByName(heads.withColumn("fp", F.col("root"))).withColumnRenamed("root", "_root")
    return marked.join(lookup, "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = materialise(fingerprints(docs), "simhash")
    return link(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
