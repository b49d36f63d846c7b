"""Removal of long repeated byte strings by a sampled suffix array (operator 2).

Every byte covered by a MATCH-byte string that also starts anywhere else is removed. A full suffix array
would carry MATCH bytes for each byte of text, so suffixes are sampled by content: a window of MATCH bytes
is owned by its leftmost smallest ANCHOR-byte gram (by hash), equal windows own equal grams at equal
offsets, and about one position in 130 is an anchor. The steps:

1. distinct texts go into a bucketed table, so that later joins move no text;
2. anchors whose gram occurs once are dropped by a count of gram hashes;
3. the suffixes at the other anchors, with the bytes before them that their windows reach, are range
   partitioned on their leading ANCHOR bytes by sampled splitters and sorted;
4. each bucket sorts its suffixes, and the reversed bytes before them, by a vectorised multikey quicksort
   that yields the common prefixes of neighbours; a window is repeated if another one owned by an equal
   gram shares both the bytes before and the bytes after. Equal leading bytes never straddle a splitter;
   a bucket is read as a stream, and the group that is open at the end of one block is carried into the
   next, which is where neighbours are compared across block boundaries;
5. gram groups of over ``hot`` members never meet in a task: their windows are counted by 128-bit digests.

Defined results: null counts as empty; texts under MATCH bytes lose nothing; a text that occurs twice
loses everything if it has MATCH bytes; overlapping repeats inside one text count; texts of any length are read whole;
rows are never lost; an empty table gives an empty table; a caller's columns stay as they are but for those named
like an added one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, read_table, slices, temporary, trim, utf8, without

MATCH = 400
ANCHOR = 128
REACH = MATCH - ANCHOR  # the most bytes of a window before its anchor
#: Window starts per segment of a long text, bytes per block of texts; both bound a task's arrays.
SEGMENT = 1 << 20
BLOCK = 1 << 19
PLACE = np.uint64((1 << 24) - 1)
#: Members that a block of gram groups gathers before it is sorted, and beyond which a group is hot.
GATHER = 16_000
HOT = 20_000

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KEYS = ("k1", "k2")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def key_columns(text_col: str = "text") -> dict[str, Column]:
    """The 128-bit key of a text (null as empty)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(2), text)}


def with_keys(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns(key_columns(text_col))


def distinct_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Table (k1, k2, copies, text) of the distinct texts, bucketed by key in the warehouse."""
    spark = df.sparkSession
    name = temporary(spark, "table", f"meshframe_texts_{uuid.uuid4().hex}")
    plain = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grouped = with_keys(plain).groupBy(*KEYS).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped.write.bucketBy(buckets, *KEYS).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * P1
    t += b
    t ^= t >> np.uint64(32)
    t *= P2
    return t


def gram_hashes(block: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position, by doubling from 8-byte words."""
    n = len(block) - 7
    g, span = np.ndarray((n,), "<u8", block, 0, (1,)) * P2, 8
    while span < ANCHOR:
        g = mix(g[:-span], g[span:])
        span *= 2
    return g ^ (g >> np.uint64(29))


def window_owners(grams: np.ndarray) -> np.ndarray:
    """For each window start the position of its leftmost smallest gram."""
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= REACH + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = REACH + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & PLACE).astype(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) of all anchors, as arrays."""
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        block = np.frombuffer(b"".join([x[2] for x in held]), np.uint8)
        grams = gram_hashes(block)
        owners = window_owners(grams)
        begin = np.cumsum([0, *(len(x[2]) for x in held)])
        starts = np.concatenate([np.arange(b, b + len(x[2]) - MATCH + 1) for b, x in zip(begin, held, strict=False)])
        own = owners[starts]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([first[1:], [len(own)]]) - 1
        at = np.searchsorted(begin, own[first], "right") - 1
        shift = np.array([x[1] for x in held])[at] - begin[at]
        found.append((np.array([x[0] for x in held])[at], grams[own[first]].view(np.int64), own[first] + shift, starts[first] + shift, starts[last] + shift))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for s in range(0, len(text) - MATCH + 1, SEGMENT):
            piece = text[s : s + SEGMENT + MATCH - 1]
            if size and size + len(piece) > BLOCK:
                flush()
            held.append((i, s, piece))
            size += len(piece)
    flush()
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


ANCHOR_ROW = "gram long, k1 long, k2 long, at int, lo int, hi int"


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", *KEYS, "at", "lo", "hi"]
    for batch in (part for b in batches for part in slices(b)):
        i, gram, at, lo, hi = anchors(utf8(batch.column(2)))
        keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[i], pa.int64()) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), *keys, *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))], names=names)
    trim()


SUFFIX_ROW = "k1 long, k2 long, at int, lo int, before binary, suffix binary"


def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix at each marked anchor of a text and the bytes before it, as far as its windows go."""
    for batch in (part for b in batches for part in slices(b)):
        k1, k2, text, marked = (batch.column(c).to_pylist() for c in range(4))
        rows: list[tuple] = []
        size = 0
        for a, b, t, ms in zip(k1, k2, text, marked, strict=True):
            for m in ms:
                p, lo, hi = m["at"], m["lo"], m["hi"]
                rows.append((a, b, p, lo, t[lo:p], t[p : hi + MATCH]))
                size += hi + MATCH - lo
                if size > 1 << 22:
                    yield to_batch(rows, SUFFIX_ROW)
                    rows, size = [], 0
        if rows:
            yield to_batch(rows, SUFFIX_ROW)
    trim()


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def multikey_order(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, vectorised over all open partitions: rows of big-endian ``words`` are split by
    their word at the current depth, and only ties go on to the next. Returns the order within groups and
    the common prefix in bytes of each row with the one before it (-1 at the start of a group)."""
    m, width = words.shape
    order = np.argsort(group, kind="stable")
    split = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    common = np.where(split, -1, 8 * width)
    for depth in range(width):
        tied = ~split
        tied[:-1] |= ~split[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        part = np.cumsum(split)[places]
        word = words[order[places], depth]
        by = np.lexsort((word, part))
        order[places] = order[places][by]
        word = word[by]
        cut = (part[1:] == part[:-1]) & (word[1:] != word[:-1])
        x = (word[1:] ^ word[:-1])[cut]
        same = sum((x < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        common[places[1:][cut]] = 8 * depth + same
        split[places[1:][cut]] = True
    return order, common


def as_words(strings: list[bytes], width: int) -> np.ndarray:
    padded = b"".join([s[:width].ljust(width, b"\0") for s in strings])
    return np.frombuffer(padded, ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def repeated_windows(group: np.ndarray, before: list[bytes], suffix: list[bytes]) -> np.ndarray:
    """flags[i, o]: the window of member i that begins o bytes before its anchor equals another member's.
    Members of a group share their anchor's gram; no two are equal."""
    m = len(before)
    most = np.array([len(b) for b in before])
    least = MATCH - np.array([len(s) for s in suffix])
    left, left_common = multikey_order(as_words([b[::-1] for b in before], REACH), group)
    right, right_common = multikey_order(as_words(suffix, MATCH), group)
    flags = np.zeros((m, REACH + 1), bool)
    behind, ahead = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(max(0, int(least.min())), int(most.max()) + 1):
        owners = np.flatnonzero((least <= o) & (o <= most))
        if len(owners) < 2:
            continue
        behind[left] = np.cumsum(left_common < o)
        ahead[right] = np.cumsum(right_common < MATCH - o)
        key = behind[owners] * (m + 1) + ahead[owners]
        by = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[by][1:] == key[by][:-1], [False]])
        flags[owners[by], o] = same[1:] | same[:-1]
    return flags


SPAN_ROW = "k1 long, k2 long, start int, end int"


def bucket_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans from one bucket's suffixes, which come sorted by their leading bytes."""
    groups: list[dict] = []  # of one gram each: (before, suffix) to its members (k1, k2, at)
    lead, held = None, 0

    def settle() -> list[tuple]:
        rows: list[tuple] = []
        group: list[int] = []
        befores, suffixes, members = [], [], []
        for g, texts in enumerate(groups):
            for (b, s), who in texts.items():
                if len(who) > 1:
                    rows.extend((k1, k2, at - len(b), at + len(s)) for k1, k2, at in who)
                if len(texts) > 1:
                    group.append(g)
                    befores.append(b)
                    suffixes.append(s)
                    members.append(who)
        if group:
            flags = repeated_windows(np.array(group), befores, suffixes)
            for i, (who, row) in enumerate(zip(members, flags, strict=True)):
                if len(who) > 1 or not row.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags[i].view(np.int8), [0]])))
                k1, k2, at = who[0]
                rows.extend((k1, k2, int(at - o2 + 1), int(at - o1 + MATCH)) for o1, o2 in zip(edge[::2], edge[1::2], strict=True))
        return rows

    for batch in (part for b in batches for part in slices(b)):
        for k1, k2, at, _, before, suffix in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            mark = suffix[:ANCHOR]
            if mark != lead:
                if held >= GATHER:
                    if rows := settle():
                        yield to_batch(rows, SPAN_ROW)
                    groups, held = [], 0
                groups.append({})
                lead = mark
            texts = groups[-1]
            who = texts.get((before, suffix))
            if who is None:
                texts[before, suffix] = [(k1, k2, at)]
            else:
                who.append((k1, k2, at))
            held += 1
    if groups and (rows := settle()):
        yield to_batch(rows, SPAN_ROW)
    groups.clear()
    trim()


WINDOW_ROW = "d1 long, d2 long, k1 long, k2 long, start int, end int"


def digest_rows(single: bool) -> Callable:
    """Digests of whole contexts (before, suffix), or with ``single`` of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b)):
            rows: list[tuple] = []
            for k1, k2, at, lo, before, suffix in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                whole = before + suffix
                for q in range(len(whole) - MATCH + 1) if single else (0,):
                    body = whole[q : q + MATCH] if single else len(before).to_bytes(4, "big") + whole
                    d = hashlib.blake2b(body, digest_size=16).digest()
                    rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), k1, k2, lo + q, lo + q + (MATCH if single else len(whole))))
                if len(rows) > 50_000:
                    yield to_batch(rows, WINDOW_ROW)
                    rows = []
            if rows:
                yield to_batch(rows, WINDOW_ROW)

    return run


def hot_spans(suffixes: DataFrame) -> DataFrame:
    """Repeated spans of the suffixes of hot grams: equal contexts first, then single windows of what is
    left, both by counts of digests that combine before they are shuffled."""
    whole = materialise(suffixes.mapInArrow(digest_rows(False), WINDOW_ROW), "contexts")
    counts = whole.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "start", "end")).alias("one"))
    often = whole.join(counts.where("n > 1").select("d1", "d2"), ["d1", "d2"]).select(*KEYS, "start", "end")
    ones = counts.select("one.k1", "one.k2", F.col("one.start").alias("lo"))
    kept = suffixes.join(ones, [*KEYS, "lo"], "left_semi").select(*suffixes.columns)
    single = materialise(kept.mapInArrow(digest_rows(True), WINDOW_ROW), "windows")
    twice = single.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return often.unionByName(single.join(twice, ["d1", "d2"]).select(*KEYS, "start", "end"))


def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(k1, k2, start, end): spans of ``texts`` (distinct) whose union is what MATCH-byte repeats cover."""
    found = materialise(texts.select(*KEYS, "text").mapInArrow(anchor_rows, ANCHOR_ROW), "anchors")
    counts = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")  # so that the join can split a hot gram
    marked = found.join(counts, "gram").select(*KEYS, F.struct("at", "lo", "hi").alias("m"), (F.col("n") > hot).alias("is_hot"))
    listed = marked.groupBy(*KEYS).agg(F.collect_list(F.when(~F.col("is_hot"), F.col("m"))).alias("few"), F.collect_list(F.when(F.col("is_hot"), F.col("m"))).alias("many"))
    listed = materialise(listed, "marked")
    body = F.col("text").cast("binary").alias("text")

    def suffixes(which: str) -> DataFrame:
        return texts.join(listed.where(F.size(which) > 0), list(KEYS)).select(*KEYS, body, which).mapInArrow(suffix_rows, SUFFIX_ROW)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.substring("suffix", 1, ANCHOR)
    spans = suffixes("few").repartitionByRange(parts, leading).sortWithinPartitions(leading).mapInArrow(bucket_spans, SPAN_ROW)
    if not listed.where(F.size("many") > 0).isEmpty():
        spans = spans.unionByName(hot_spans(suffixes("many")))
    return spans


def merged(spans: list, size: int, copies: int) -> list[tuple[int, int]]:
    """The union of spans as maximal runs; a text with copies is one run if it has MATCH bytes."""
    if copies > 1:
        return [(0, size)] if size >= MATCH else []
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(texts: DataFrame, hot: int = HOT, rows: DataFrame | None = None) -> DataFrame:
    """``texts`` (k1, k2, copies, text) with ``kept`` binary, the bytes that stay, and ``removed``, the
    maximal removed runs, in place of the text. With ``rows`` (k1, k2, _own) one row for each of these, with its ``_own``:
    the rows go to the texts in their buckets, so that no text moves again."""
    spans = repeated_spans(texts, hot).groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(spans, list(KEYS), "left").select(*KEYS, F.struct(F.col("text").cast("binary").alias("text"), "copies", "spans").alias("held"))
    if rows is not None:
        joined = joined.join(rows, list(KEYS))
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make() -> Callable:
        def kernel(column: pa.Array) -> list:
            kept, removed = [], []
            body, copies, spans = (column.field(i).to_pylist() for i in range(3))
            for text, n, found in zip(body, copies, spans, strict=True):
                runs = merged(found, len(text), n)
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    text = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(text)
                removed.append([{"start": s, "end": e} for s, e in runs])
            return [pa.array(kept, pa.binary()), pa.array(removed, runs_type)]

        return kernel

    return add_columns(joined, "held", T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("removed", SPANS)]), make, drop_source=True)


def as_text(df: DataFrame, bytes_col: str, out_col: str) -> DataFrame:
    """``df`` with kept bytes as text in place of the bytes; a character that an edge cut is left out."""
    make = lambda: lambda column: [pa.array([b.decode("utf-8", "ignore") for b in utf8(column)], pa.string())]
    return add_columns(df, bytes_col, T.StructType([T.StructField(out_col, T.StringType())]), make, drop_source=True)


def remove_repeats(df: DataFrame, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``df`` with ``kept`` and ``removed`` for each row's text; columns of those names are replaced."""
    results = cut(distinct_texts(df, text_col), hot)
    rows = without(df, ["kept", "removed"])
    keys = {k: f"_{k}_of_text" for k in KEYS}
    keyed = rows.join(results.withColumnsRenamed(keys), [digest_of == F.col(keys[k]) for k, digest_of in key_columns(text_col).items()])
    return keyed.select(*[F.col(f"`{c}`") for c in rows.columns], "kept", "removed")


def digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the digest of the bytes that stay."""
    results = cut(distinct_texts(docs), hot).select(
        *KEYS, (F.octet_length("kept") + (gone := F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]))).cast("long").alias("n_bytes"),
        gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
    return with_keys(docs.select("doc_id", "text")).drop("text").join(results, list(KEYS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))
