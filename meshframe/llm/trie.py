"""Prefix trie of conversations from the LCP array of their sorted order (operator 12).

A conversation is the sequence of its turns' 128-bit digests; equal sequences are one row with a count. The distinct
sequences are range partitioned and sorted, and each partition is a block. ``ordered`` gives the LCP of neighbours (in
turns), ``records`` runs one stack over each block, which yields the Cartesian tree's intervals with equal LCP merged,
and leaves open only what a block can't tell: the chains of its smallest values from either end. ``resolved`` answers
these by all-nearest-smaller-values over the blocks: the block minima, a number a block, name the block that holds the
answer, and a join with that block's chain finds the position. ``nodes`` takes sums over an interval as differences of
prefix sums, and writes one row for each depth between an interval and the one around it.

What is held at once: a conversation's digests and byte counts (24 bytes a turn) in a row, a stack of at most the
depth of the trie in a task, three numbers for each block (shuffle partition) on the driver.

Defined results: a null role or text is empty; turns go by number, null first, equal numbers by digest; rows without a
conversation id belong to none; a conversation whose rebuilt form has no turns is a member of the root; repeated
conversations are members each; an empty table has no nodes; other columns don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, small_batches

DIGEST = 16
#: Turns that a rebuilt conversation can take from another one: h is under 9.
LENT, GROUP = 8, 5
#: Bytes of ids that are hashed at once.
PIECE = 1 << 16
END = 1 << 62


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, bytes>>) of rows (conv_id, turn, role, text), in order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    made = rows.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # array_sort puts a struct with a null first field before others
    return made.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % 5 and goes on with its own after h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    lent = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_from"), F.slice("turns", 1, LENT).alias("_lent"))
    both = own.withColumn("_from", F.col("conv_id") - F.col("conv_id") % GROUP).join(lent, "_from", "left").withColumn("h", h)
    first = F.coalesce(F.slice("_lent", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """The turns that two sequences of digests begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    k = 0
    while k < min(n, 16):
        if a[k * DIGEST : (k + 1) * DIGEST] != b[k * DIGEST : (k + 1) * DIGEST]:
            return k
        k += 1
    x, y = (np.frombuffer(s, np.uint8, (n - k) * DIGEST, k * DIGEST) for s in (a, b))
    off = np.flatnonzero(x != y)
    return k + (int(off[0]) // DIGEST if len(off) else n - k)


ORDERED = "block int, idx long, lcp int, len int, cum array<long>, low long, n long, seq binary, first binary, last binary"


def ordered(distinct: DataFrame) -> DataFrame:
    """Distinct sequences (key, bytes, low, n) in sorted blocks: place in the block, turns, running sums of bytes, LCP
    with the row before (-2 for the first of a block), and the keys at either end of a block."""
    names = [c.split()[0] for c in ORDERED.split(", ")]
    spark = distinct.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").select(F.spark_partition_id().alias("block"), "key", "bytes", "low", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("idx", pa.int64()), ("lcp", pa.int32()), ("len", pa.int32()), ("cum", pa.list_(pa.int64())), ("low", pa.int64()), ("n", pa.int64()), ("seq", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
        idx, before, held = 0, None, None
        for batch in batches:
            out = [held] if held else []
            for block, key, sizes, low, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lcp = -2 if before is None else common_turns(before, key)
                out.append([block, idx, lcp, len(sizes), np.cumsum(sizes).tolist() if sizes else [], low, n, hashlib.sha256(key).digest(), None if idx else key, None])
                before, idx = key, idx + 1
            if out:
                held = out.pop()  # the last row so far may be the block's last
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            held[-1] = before
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, ORDERED).select(*names)


def borders(sorted_rows: DataFrame) -> list[tuple[int, int, int]]:
    """(block, rows before it, LCP of its first sequence with the one before): a row for each block."""
    ends = sorted_rows.groupBy("block").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.max("last").alias("last"))
    told = ends.withColumn("before", F.lag("last").over(Window.orderBy("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, n, first, before = (c.to_pylist() for c in batch.columns)
            lcp = [-1 if b is None else common_turns(b, a) for a, b in zip(first, before, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(n, pa.int64()), pa.array(lcp, pa.int32())], names=["block", "n", "lcp"])

    out, base = [], 0
    for r in sorted(told.select("block", "n", "first", "before").mapInArrow(run, "block int, n long, lcp int").collect()):
        out.append((r.block, base, r.lcp))
        base += r.n
    return out


def measured(sorted_rows: DataFrame, edges: list[tuple[int, int, int]]) -> DataFrame:
    """The sequences by place in the whole order, with their LCPs on both sides and sums over all before them: of
    conversations, of leaves, of their bytes, of bytes that the sequence before doesn't share."""
    spark = sorted_rows.sparkSession
    after = [x[2] for x in edges[1:]] + [-1] * bool(edges)
    around = spark.createDataFrame([(*x, y) for x, y in zip(edges, after, strict=True)], "block int, base long, own int, after int")
    step = Window.partitionBy("block").orderBy("pos")
    at = lambda c, k: F.when(k > 0, F.element_at(c, k)).otherwise(F.lit(0))
    df = sorted_rows.join(F.broadcast(around), "block").withColumn("pos", F.col("base") + F.col("idx")).withColumn("lcp", F.when(F.col("idx") == 0, F.col("own")).otherwise(F.col("lcp")))
    df = df.withColumn("next", F.coalesce(F.lead("lcp").over(step), "after"))
    total = at(F.col("cum"), F.col("len"))
    df = df.withColumns({"total": total, "fresh": total - at(F.col("cum"), F.col("lcp")), "leaf": (F.col("next") < F.col("len")).cast("long")})
    sums = {"s_n": F.col("n"), "s_leaf": F.col("leaf"), "s_all": F.col("n") * F.col("total"), "s_fresh": F.col("fresh")}
    inner = step.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({k: F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in sums.items()}).withColumns({f"own_{k[2:]}": c for k, c in sums.items()})
    return df.select("block", "pos", "lcp", "next", "len", "cum", "low", "n", "seq", "total", "fresh", *sums, *[f"own_{k[2:]}" for k in sums])


SUMS = ("n", "leaf", "all", "fresh")


def with_bases(local: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Sums within blocks become sums over all blocks before; also the sums over everything."""
    totals = local.groupBy("block").agg(*[F.sum(f"own_{k}").alias(k) for k in SUMS]).orderBy("block").collect()
    running, rows = dict.fromkeys(SUMS, 0), []
    for r in totals:
        rows.append((r.block, *[running[k] for k in SUMS]))
        running = {k: running[k] + r[k] for k in SUMS}
    bases = local.sparkSession.createDataFrame(rows, "block int, " + ", ".join(f"b_{k} long" for k in SUMS))
    joined = local.join(F.broadcast(bases), "block").withColumns({f"s_{k}": F.col(f"s_{k}") + F.col(f"b_{k}") for k in SUMS})
    return joined.drop(*[f"b_{k}" for k in SUMS], *[f"own_{k}" for k in SUMS]), running


#: place: a position and its interval; interval: its ends where the block tells them; tail and head: the smallest
#: values from the end and from the start of a block, with the least conversation between them and that end.
RECORDS = "kind string, block int, id long, v int, pos long, l long, r long, l_lcp int, r_lcp int, low long, eq long"


def records(rows: DataFrame) -> DataFrame:
    """One stack over each block of rows (block, pos, lcp, low). A stack entry is an open interval: the LCP, the
    first sequence (none if it lies before the block), the least conversation so far, the places of that LCP."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("block", "pos", "lcp", "low").repartition(parts, "block").sortWithinPartitions("block", "pos")
    fields = [c.split() for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block, stack, made, last, before = None, [], 0, 0, END

        def close() -> None:
            """What is still open when a block ends."""
            low = before
            spot = last
            for k in range(len(stack) - 1, -1, -1):
                v, first, least, eq, own = stack[k]
                out.append(("tail", block, None, v, spot, None, None, None, None, low, None))
                low = min(low, least)
                out.append(("interval", block, own, v, None, first, None, stack[k - 1][0] if k else None, None, low, eq))
                spot = first

        def flush() -> pa.RecordBatch:
            made_batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made_batch

        for batch in batches:
            for b, pos, x, low in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block:
                    if block is not None:
                        close()
                    block, stack, first, least = b, [], None, END
                    out.append(("head", b, None, x, pos, None, None, None, None, END, None))
                else:
                    first, least = last, before
                while stack and stack[-1][0] > x:
                    v, first, mine, eq, own = stack.pop()
                    least = min(least, mine)
                    out.append(("interval", b, own, v, None, first, pos, stack[-1][0] if stack else None, x, least, eq))
                    if not stack:
                        out.append(("head", b, None, x, pos, None, None, None, None, least, None))
                if stack and stack[-1][0] == x:
                    stack[-1][2] = min(stack[-1][2], least)
                    stack[-1][3] += 1
                else:
                    stack.append([x, first, least, 1, made])
                    made += 1
                out.append(("place", b, stack[-1][4], x, pos, None, None, None, None, None, None))
                last, before = pos, low
            if len(out) > 20_000:
                yield flush()
        if block is not None:
            close()
            yield flush()

    return dealt.mapInArrow(run, RECORDS)


def resolved(made: DataFrame, count: int) -> DataFrame:
    """Every interval (block, id, v, l, r, l_lcp, r_lcp, low, eq) with both its ends; ``count`` sequences in all."""
    spark = made.sparkSession
    intervals = made.where("kind = 'interval' and v >= 0").select("block", "id", "v", "l", "r", "l_lcp", "r_lcp", "low", "eq")
    mins = sorted((r.block, r.v, r.low) for r in made.where("kind = 'interval' and l is null and r is null").select("block", "v", "low").collect())
    blocks, least, lows = ([x[k] for x in mins] for k in range(3))
    before, after = nearest_smaller(least), [len(least) - 1 - k for k in reversed(nearest_smaller(least[::-1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {b: k for k, b in enumerate(blocks)}
        for batch in batches:
            left, right, between = [], [], []
            for b, v, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("block", "v", "l", "r")], strict=True):
                k = place[b]
                i, j = k - 1, k + 1
                if lo is None:
                    while least[i] >= v:  # the first sequence has LCP -1
                        i = before[i]
                if hi is None:
                    while j < len(least) and least[j] >= v:
                        j = after[j]
                left.append(blocks[i] if lo is None else None)
                right.append(blocks[j] if hi is None and j < len(least) else None)
                mid = [*(lows[i + 1 : k] if lo is None else ()), *(lows[k + 1 : j] if hi is None else ())]
                between.append(min(mid, default=END))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(between, pa.int64())], names=[*batch.schema.names, "left", "right", "between"])

    open_ = intervals.where("l is null or r is null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema) + ", left int, right int, between long"
    chain = lambda kind, at, name: made.where(F.col("kind") == kind).groupBy(F.col("block").alias(at)).agg(F.collect_list(F.struct("v", "pos", "low")).alias(name))
    both = open_.mapInArrow(run, kinds).join(chain("tail", "left", "tail"), "left", "left").join(chain("head", "right", "head"), "right", "left")
    hit = lambda c: F.array_max(F.filter(c, lambda x: x["v"] < F.col("v")))
    both = both.withColumns({"t": hit("tail"), "h": hit("head")})
    answered = both.select(
        "block", "id", "v", F.coalesce("l", "t.pos").alias("l"), F.coalesce("r", "h.pos", F.lit(count).cast("long")).alias("r"), F.coalesce("l_lcp", "t.v").alias("l_lcp"),
        F.coalesce("r_lcp", "h.v", F.lit(-1)).alias("r_lcp"), F.least("low", "between", "t.low", "h.low").alias("low"), "eq",
    )
    return intervals.where("l is not null and r is not null").unionByName(answered)


def nearest_smaller(values: list[int]) -> list[int]:
    """The nearest position to the left with a smaller value, -1 if there is none."""
    out: list[int] = []
    for k, v in enumerate(values):
        j = k - 1
        while j >= 0 and values[j] >= v:
            j = out[j]
        out.append(j)
    return out


def hashed_ends(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the ids of each sequence of ``members`` (conv_id, seq), ascending and joined by commas.
    Ids are sorted over all partitions and joined to pieces of PIECE bytes there; only pieces meet in one task, which
    feeds them to the hash one by one."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("seq", "conv_id").repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, size = None, [], 0
        names = ["seq", "first", "ids"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=names)
        for batch in batches:
            rows = []
            for s, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != seq or size > PIECE:
                    if ids:
                        rows.append((seq, ids[0], ",".join(map(str, ids))))
                    seq, ids, size = s, [], 0
                ids.append(i)
                size += 20
            if rows:
                yield pack(rows)
        if ids:
            yield pack([(seq, ids[0], ",".join(map(str, ids)))])

    pieces = dealt.mapInArrow(join, "seq binary, first long, ids string").repartition(parts, "seq").sortWithinPartitions("seq", "first")

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["seq", "ends"])
        for batch in batches:
            rows = []
            for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != seq:
                    if state:
                        rows.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield pack(rows)
        if state:
            yield pack([(seq, state.hexdigest())])

    return pieces.mapInArrow(hash_, "seq binary, ends string")


def nodes(convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (conv_id, turns array<struct<digest, bytes>>), a row for each node."""
    keyed = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    keyed = materialise(keyed, "trie-convs")
    distinct = keyed.groupBy("key", "bytes").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"))
    blocks = materialise(ordered(distinct), "trie-sorted")
    edges = borders(blocks)
    seqs, totals = with_bases(materialise(measured(blocks, edges), "trie-measured"))
    seqs = materialise(seqs, "trie-sequences")
    count = seqs.count()
    made = materialise(records(seqs), "trie-records")
    full = materialise(resolved(made, count), "trie-intervals")

    inner = full.groupBy("l", "v").agg(F.max("r").alias("r"), F.max("l_lcp").alias("l_lcp"), F.max("r_lcp").alias("r_lcp"), F.min("low").alias("low"), F.sum("eq").alias("eq"))
    start = seqs.select(F.col("pos").alias("l"), "len", "cum", "seq", "total", "fresh", *[F.col(f"s_{k}").alias(f"l_{k}") for k in SUMS])
    stop = seqs.select(F.col("pos").alias("r"), *[F.col(f"s_{k}").alias(f"r_{k}") for k in SUMS])
    stop = stop.unionByName(seqs.sparkSession.createDataFrame([(count, *[totals[k] for k in SUMS])], "r long, " + ", ".join(f"r_{k} long" for k in SUMS)))
    held = lambda k: F.col(f"r_{k}") - F.col(f"l_{k}")
    top: Column = F.greatest("l_lcp", "r_lcp")
    # Bytes of all members less those of the distinct nodes; a depth takes off what lies above it
    wide = inner.join(start, "l").join(stop, "r").select(
        "l", "v", top.alias("p"), "low", held("n").alias("n_convs"), held("leaf").alias("n_leaves"), (held("all") - held("fresh") + F.col("fresh") - F.col("total")).alias("saved"),
        (F.col("eq") + 1 - (F.col("len") == F.col("v")).cast("int")).alias("n_children"), "cum", F.when(F.col("len") == F.col("v"), F.col("seq")).alias("seq"),
    )
    side = F.greatest("lcp", "next")
    alone = seqs.where(F.col("len") > side).select(
        F.col("pos").alias("l"), F.col("len").alias("v"), side.alias("p"), "low", F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("total")).alias("saved"),
        F.lit(0).cast("long").alias("n_children"), "cum", "seq",
    )
    runs = wide.unionByName(alone)
    # The interval around a run holds the run's first sequence as its own first one, or as a place of its LCP
    places = made.where("kind = 'place' and v >= 0").select("block", "id", F.col("pos").alias("l")).join(full.select("block", "id", "v", "low"), ["block", "id"])
    around = inner.select("l", F.col("v").alias("p"), F.col("low").alias("parent")).unionByName(places.select("l", F.col("v").alias("p"), F.col("low").alias("parent")))
    ends = hashed_ends(keyed.select("conv_id", F.unhex(F.sha2("key", 256)).alias("seq")))
    runs = runs.join(around, ["l", "p"], "left").join(ends, "seq", "left")
    depth = F.explode(F.sequence(F.col("p") + 1, F.col("v"))).alias("depth")
    rows = runs.select("*", depth)
    above = F.when(F.col("depth") > 1, F.element_at("cum", F.greatest(F.col("depth") - 1, F.lit(1)))).otherwise(F.lit(0))
    last = F.col("depth") == F.col("v")
    return rows.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("p") + 1, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("saved") - (F.col("n_convs") - 1) * above).alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return nodes(rebuilt(materialise(sequences(rows), "trie-turns")))
