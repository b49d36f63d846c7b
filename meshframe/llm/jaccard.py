"""Near-duplicates by five-word shingles at a Jaccard similarity of 0.8 or more.

``signatures`` adds a digest of each text's words and its bucket keys: those of the SimHash's covering tables, over the
five-word shingles, and BANDS more, each a hash of ROWS minima of the shingles' hashes. The tables meet every pair
within two bits; most pairs of similarity 0.8 are 3 to 11 bits apart, and for them covering tables would be thousands.
Texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, all but 4 in a million at 0.8.
``edges`` compares the distinct texts that share a key on their whole shingle sets, so no pair under 0.8 is
linked. Members of a bucket are put one after another to the components of those before them: one that fits a
component's first member takes one comparison, and what leaves a task is a link a member, never the pairs.
Buckets with the same members are compared once.

No task takes more of a bucket than about MEMBERS texts or SET_BYTES of sets (one set at least). A larger bucket is cut
into parts by a hash; the first members of the parts' components meet again, level by level, as long as that halves
the parts, which joins near copies of any number with a comparison or so each. What those levels can't tell is settled
exactly: members of one bucket that are in different components by then meet in a grid of blocks, all members
outside the bucket's largest component against one another and against that one.

Defined results: words are those of ``simhash``; null, empty and wordless texts are equal to each other; a text of
under five words is one shingle; texts of equal words are one text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, utf8
from .simhash import LOWER, MASKS, MULTIPLIER, SEED, components, covering_keys, folded

SHINGLE = 5
BANDS = 24
ROWS = 4
#: Shingles that are mixed with all multipliers at once.
CHUNK = 4_096
#: Texts of one bucket that meet in one task, and the bytes of their shingle sets.
MEMBERS, SET_BYTES = 1_000, 16 << 20
FIELDS = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_size", T.LongType())])
MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    grams = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.array([hashed(g, SEED) for g in grams], np.uint64))


def bands(held: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(held), CHUNK):
        np.minimum(least, ((held[at : at + CHUNK, None] ^ MIX[0]) * (MIX[1] | np.uint64(1))).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * MULTIPLIER
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_key``, a digest of the text's words, ``_bands``, its bucket keys, and ``_size``, the bytes of its set."""
    import xxhash

    def kernel(column: pa.Array) -> list:
        cells = utf8(column)
        keys = [xxhash.xxh3_64_intdigest(b" ".join(b.translate(LOWER).split()), SEED) for b in cells]
        sets = [shingles(b) for b in cells]
        flat = np.concatenate([x for held in sets for x in (bands(held), covering_keys(folded(held)))]) if cells else np.empty(0, np.int64)
        offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (BANDS + len(MASKS)))
        return [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([held.nbytes for held in sets], pa.int64())]

    make: Callable = lambda: kernel
    return add_columns(df, text_col, FIELDS, make)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def grouped(sets: list[np.ndarray]) -> list[list[int]]:
    """The components of the places of ``sets`` under all similar pairs."""
    groups: list[list[int]] = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        fits = [g for g in groups if any(similar(sets[i], sets[j]) for j in g)]
        if len(fits) == 1:
            fits[0].append(i)
            continue
        if fits:
            groups = [g for g in groups if not any(g is f for f in fits)]
        groups.append([*(j for f in sorted(fits, key=len, reverse=True) for j in f), i])
    return groups


def parts(n: Column, size: Column) -> Column:
    """Into how many parts texts of that number and size go."""
    return F.greatest(F.ceil(n / MEMBERS), F.ceil(size / SET_BYTES), F.lit(1)).cast("int")


def linked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, parts, a, b, size): the members b of each component within a part of a bucket, with its smallest digest a;
    in a bucket of several parts also a itself. ``members`` is (bucket, parts, _key, _size)."""

    def run(part: pa.Table) -> pa.Table:
        keys, sizes = part.column("_key").to_pylist(), part.column("_size").to_pylist()
        split = part.column("parts")[0].as_py() > 1
        found = grouped([np.frombuffer(b, np.uint64) for b in part.column("_set").to_pylist()])
        rows = [(min(keys[i] for i in g), keys[j], sizes[j]) for g in found for j in g]
        rows = [r for r in rows if split or r[0] < r[1]]
        n = len(rows)
        shared = [pa.array([part.column(c)[0].as_py()] * n, kind) for c, kind in (("bucket", pa.int64()), ("parts", pa.int32()))]
        return pa.table([*shared, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["bucket", "parts", "a", "b", "size"])

    cut = members.withColumn("part", F.pmod(F.xxhash64("_key", "bucket"), F.col("parts")))
    return cut.join(sets, "_key").groupBy("bucket", "part").applyInArrow(run, "bucket long, parts int, a long, b long, size long")


def crossed(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join the components ``roots`` (node, root) of the ``members`` of a bucket as all similar pairs of
    members in different components would."""
    rooted = members.join(roots.withColumnRenamed("node", "_key"), "_key", "left").select("bucket", "_key", "_size", F.coalesce("root", "_key").alias("root"))
    rooted = materialise(rooted, "rooted")
    tally = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("_size").alias("size"))
    grid = tally.groupBy("bucket").agg(F.max(F.struct("n", "size", "root")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    grid = grid.select("bucket", F.col("top.root").alias("largest"), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), parts(F.col("top.n"), F.col("top.size")).alias("many"))
    h, few = F.xxhash64("_key"), F.col("few")
    own = F.when(F.col("root") != F.col("largest"), F.pmod(h, few)).otherwise(few + F.pmod(h, F.col("many"))).cast("int")
    placed = rooted.join(grid, "bucket").withColumn("own", own)
    left = placed.where("own < few").select("bucket", "_key", "root", F.col("own").alias("s"), F.explode(F.sequence("own", few + F.col("many") - 1)).alias("o"), F.lit(True).alias("left"))
    right = placed.select("bucket", "_key", "root", F.explode(F.sequence(F.lit(0), F.least("own", few - 1))).alias("s"), F.col("own").alias("o"), F.lit(False).alias("left"))

    def run(cell: pa.Table) -> pa.Table:
        rows = list(zip(*(cell.column(c).to_pylist() for c in ("left", "_key", "root")), [np.frombuffer(b, np.uint64) for b in cell.column("_set").to_pylist()], strict=True))
        head = {r[2]: r[2] for r in rows}

        def find(x: int) -> int:
            while head[x] != x:
                x = head[x]
            return x

        out = []
        for _, k, r, mine in (x for x in rows if x[0]):
            for _, other, q, theirs in (x for x in rows if not x[0]):
                if r != q and (one := find(r)) != (two := find(q)) and similar(mine, theirs):
                    head[max(one, two)] = min(one, two)
                    out.append((min(k, other), max(k, other)))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return left.unionByName(right).join(sets, "_key").groupBy("bucket", "s", "o").applyInArrow(run, "a long, b long")


def edges(marked: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, over the digests ``_key`` of ``marked`` (_key, _bands, _size, _row, text)."""
    texts = marked.groupBy("_key").agg(F.min(F.struct("_row", "_bands", "_size")).alias("one")).select("_key", "one.*")
    cells = materialise(texts.select("_key", "_row", "_size", F.explode(F.array_distinct("_bands")).alias("bucket")), "cells")
    same = [F.bit_xor(F.xxhash64("_key", F.lit(k))).alias(f"same{k}") for k in (0, 1)]
    held = cells.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("_size").alias("size"), *same).where("n > 1")
    once = held.groupBy("n", "size", "same0", "same1").agg(F.min("bucket").alias("bucket")).select("bucket", parts(F.col("n"), F.col("size")).alias("parts"))
    members = materialise(cells.join(once, "bucket").select("bucket", "parts", "_key", "_row", "_size"), "buckets")
    make: Callable = lambda: lambda column: [pa.array([shingles(b).tobytes() for b in utf8(column)], pa.binary())]
    wanted = marked.select("_row", "_key", "text").join(members.select("_row").distinct(), "_row", "left_semi").drop("_row")
    sets = materialise(add_columns(wanted, "text", T.StructType([T.StructField("_set", T.BinaryType())]), make, drop_source=True), "shingles")
    level = members = members.drop("_row")
    found: list[DataFrame] = []
    while True:
        made = materialise(linked(level, sets), "linked")
        found.append(made.where("a < b").select("a", "b"))
        first = made.where("parts > 1 and a = b").select("bucket", "parts", F.col("a").alias("_key"), F.col("size").alias("_size"))
        fewer = first.groupBy("bucket").agg(parts(F.count("*"), F.sum("_size")).alias("now"), F.min("parts").alias("parts"))
        level = materialise(first.drop("parts").join(fewer.where("2 * now <= parts"), "bucket").select("bucket", F.col("now").alias("parts"), "_key", "_size"), "first")
        if level.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, found).distinct()
    large = members.where("parts > 1")
    if large.isEmpty():
        return pairs
    return pairs.unionByName(crossed(large, components(pairs), sets)).distinct()


def link(marked: DataFrame) -> DataFrame:
    """``marked`` (_key, _bands, _size, _row, text) with ``_root``, the smallest digest of its component."""
    return marked.join(components(edges(marked)).withColumnRenamed("node", "_key"), "_key", "left").withColumn("_root", F.coalesce("root", "_key")).drop("root")
