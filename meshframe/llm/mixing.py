"""Mixing sources to target weights by Pfair scheduling (operator 6).

Each source's documents, in a fixed shuffled order, form blocks. With the share w of the weights, block j of a
source is released at floor((j - 1) / w) and due at ceil(j / w), in whole numbers from the exact weights and
counted over the whole phase; the earliest deadline among the released blocks takes the next slot. As the shares
add up to one, no deadline is missed, so at every slot a source is less than one block from its target, however
long the phase. A phase ends when a source runs out, and the rest goes on with the remaining sources at their
relative weights: at most one phase a source.

A phase of more than PIECE slots is worked out in tasks, a range of slots each. At any slot a source has served the
whole part of its exact target or one block more, so a range can begin with a guess: WARM slots before it, the sources
due first have the block more, and the rule itself brings the guess to what the schedule has there. Then the end of
each range is compared with the beginning of the next one, and ranges that began wrong are done again from that end
until all fit, so the result is that of going from slot to slot. Shorter phases, one range each, are done on the driver.
Documents look up their slot by a join. Ranks inside a source come from counts of hash buckets, so a source of any
size is spread over many tasks.

Defined results: every document is placed once, none is dropped or repeated; a null source counts as the
source ''; unknown and negative weights raise;
sources of weight 0 follow the others; rows with equal texts, integers and strings are ordered arbitrarily among themselves; an empty table gives
an empty table; columns that clash with the added ones are replaced."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, settle, shared_folder, temporary, without

BLOCK = 16
#: Slots of a range, done in one go, and those before it that a guess of its beginning goes through.
PIECE, WARM = 200_000, 2_000
#: Rows of an Arrow batch, and tasks that write a long phase, at most.
ROWS, MAX_TASKS = 10_000, 10_000
#: Without given weights a source's weight is its number of documents to this power.
TEMPERATURE = 0.5
#: Documents of a hash bucket, about.
BUCKET = 2_000
ADDED = ["block", "slot", "phase", "lag"]


def allotments(weights: dict[str, float], least: int = 1) -> dict[str, int]:
    """The weights in exact proportion as whole numbers that add up to ``least`` or more."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if min(exact.values(), default=0) < 0:
        raise ValueError("negative weight")
    unit = math.lcm(*[x.denominator for x in exact.values()])
    total = sum(exact.values()) * unit
    unit *= max(1, -(-least // int(total))) if total else 1
    return {s: int(x * unit) for s, x in exact.items()}


def earliest(rates: dict[str, int], slot: int = 0, served: dict[str, int] | None = None, exact: bool = True) -> Iterator[str]:
    """The source of each slot: earliest deadline first among the released blocks, without end. It begins at ``slot`` with
    the blocks that are ``served`` by then; ``exact`` raises where a block is late, which a guess may be."""
    whole = sum(rates.values())
    served = dict(served) if served else dict.fromkeys(rates, 0)
    coming: list[tuple[int, str]] = [(served[s] * whole // c, s) for s, c in rates.items()]
    heapq.heapify(coming)
    ready: list[tuple[int, str]] = []
    while True:
        while coming and coming[0][0] <= slot:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(served[s] + 1) * whole // rates[s]), s))
        if not ready:  # only after a wrong guess
            slot = coming[0][0]
            continue
        due, s = heapq.heappop(ready)
        if exact and due <= slot:
            raise AssertionError(f"block {served[s]} of {s} is late")
        yield s
        served[s] += 1
        heapq.heappush(coming, (served[s] * whole // rates[s], s))
        slot += 1


def advanced(rates: dict[str, int], slot: int, served: dict[str, int], steps: int, exact: bool = True) -> dict[str, int]:
    """The served blocks ``steps`` slots later."""
    after = dict(served)
    for s in islice(earliest(rates, slot, served, exact), steps):
        after[s] += 1
    return after


def guess(rates: dict[str, int], slot: int, warm: int) -> dict[str, int]:
    """The blocks that are probably served at a slot, from ``warm`` slots before it."""
    whole, start = sum(rates.values()), max(0, slot - warm)
    served = {s: c * start // whole for s, c in rates.items()}
    more = start - sum(served.values())
    due = sorted((-(-(served[s] + 1) * whole // c), s) for s, c in rates.items() if served[s] * whole // c < start)
    for _, s in due[:more]:
        served[s] += 1
    return advanced(rates, start, served, slot - start, exact=False)


def bound(left: dict[str, int], rates: dict[str, int]) -> int:
    """Slots of a phase at most: by its last deadline a source has run out."""
    whole = sum(rates.values())
    return min(-(-left[s] * whole // c) for s, c in rates.items())


def phase_rows(phase: int, start: int, slot: int, rates: dict[str, int], served: dict[str, int], first: dict[str, int]) -> Iterator[tuple[int, str, int, int, float]]:
    """(phase, source, block, slot, lag) from a slot of a phase on, without end; lag is the exact target less the served
    blocks of the phase. The phase began at slot ``start`` of the mix, after ``first`` blocks of each source."""
    whole, done = sum(rates.values()), dict(served)
    for s in earliest(rates, slot, served):
        done[s] += 1
        slot += 1
        yield phase, s, first[s] + done[s] - 1, start + slot - 1, (rates[s] * slot - done[s] * whole) / whole


def rates_of(left: dict[str, int], share: dict[str, int]) -> dict[str, int]:
    return {s: share[s] for s in left if share[s]} or dict.fromkeys(left, 1)


def places(blocks: dict[str, int], share: dict[str, int], most: float = math.inf, done: dict[str, int] | None = None, phase: int = 0) -> Iterator[tuple[int, str, int, int, float]]:
    """``phase_rows`` of every block in the order of the slots, up to the first phase that may have over ``most`` slots.
    ``done`` are the blocks placed in earlier phases and takes in those placed here."""
    done = {} if done is None else done
    left = {s: n for s, n in blocks.items() if n > done.setdefault(s, 0)}
    while left:
        rates, first = rates_of(left, share), dict(done)
        if bound({s: n - done[s] for s, n in left.items()}, rates) > most:
            return
        for row in phase_rows(phase, sum(done.values()), 0, rates, dict.fromkeys(rates, 0), first):
            s = row[1]
            done[s] += 1
            yield row
            if done[s] == left[s]:
                del left[s]
                break
        phase += 1


def hashed(docs: DataFrame, source_col: str = "source") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``docs`` with ``_source``, a hash bucket ``_bucket`` and the row ``_row`` from 1 in the hash order of source and bucket;
    (_source, _bucket, n, _offset), the rows of each bucket and those of its source before it; and the sources' counts."""
    keys = [c for c in docs.columns if c != "text" and docs.schema[c].dataType.typeName() in ("long", "integer", "string")]
    source = F.coalesce(F.col(f"`{source_col}`"), F.lit(""))
    marked = docs.withColumns({"_source": source, "_hash": F.xxhash64(*[F.col(f"`{k}`") for k in keys])})
    buckets = max(1, -(-docs.count() // BUCKET))
    marked = marked.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 8), F.lit(buckets)))
    sizes = marked.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["_source"]: r["n"] for r in sizes.groupBy("_source").agg(F.sum("n").alias("n")).collect()}
    ties = [F.xxhash64("text")] if "text" in docs.columns else []
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", *[F.col(f"`{k}`") for k in keys], *ties))
    return marked.withColumn("_row", within).drop("_hash"), offsets, counts


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, source_col: str = "source") -> DataFrame:
    """``docs`` with ``block`` (its number within the source), ``slot`` (place of the block in the mix),
    ``phase`` and ``lag`` (exact target less served blocks of the phase after the slot, under one either way).

    The rows of a bucket have ranks without a gap, so the places of its blocks are gathered first and join by bucket, as
    the rows lie: documents move once, into their buckets."""
    docs = without(docs, ADDED)
    marked, offsets, counts = hashed(docs, source_col)
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in counts.items()}
    elif missing := set(counts) - set(weights):
        raise ValueError(f"no weight for sources {sorted(missing)}")
    blocks = {s: -(-n // block) for s, n in counts.items()}
    place = placed(docs.sparkSession, blocks, allotments({s: weights[s] for s in blocks}))
    number = lambda rank: F.floor(rank / block).cast("long")
    met = offsets.withColumn("block", F.explode(F.sequence(number(F.col("_offset")), number(F.col("_offset") + F.col("n") - 1))))
    slots = F.array_sort(F.collect_list(F.struct("block", "slot", "phase", "lag"))).alias("_slots")
    held = met.join(place, ["_source", "block"]).groupBy("_source", "_bucket").agg(F.min("_offset").alias("_offset"), slots)
    found = marked.join(held, ["_source", "_bucket"]).withColumn("_rank", F.col("_offset") + F.col("_row") - 1)
    at = F.element_at("_slots", (number(F.col("_rank")) - F.col("_slots")[0]["block"] + 1).cast("int"))
    return found.withColumn("_at", at).select(*[F.col(f"`{c}`") for c in docs.columns], "_at.block", "_at.slot", "_at.phase", "_at.lag", "_rank")


def placed(spark: SparkSession, blocks: dict[str, int], share: dict[str, int]) -> DataFrame:
    """``places`` as a table (phase, _source, block, slot, lag). Long phases are worked out in tasks; what the driver
    holds at once is short phases of PIECE slots in all, and a number per source."""
    schema = "phase int, _source string, block long, slot long, lag double"
    done: dict[str, int] = {}
    phase, frames = 0, []
    path = ""
    while True:
        rows = places(blocks, share, PIECE, done, phase)
        while piece := list(islice(rows, PIECE)):
            phase = piece[-1][0] + 1
            frames.append(spark.createDataFrame(piece, schema))
            if len(piece) == PIECE or path:
                path = path or temporary(spark, "path", f"{shared_folder(spark)}/places-{uuid.uuid4().hex}")
                frames.pop().write.mode("append").parquet(path)
        left = {s: n - done[s] for s, n in blocks.items() if n > done[s]}
        if not left:
            break
        rates, first = rates_of(left, share), {s: done[s] for s in left}
        in_tasks = settle(long_phase(spark, phase, sum(done.values()), rates, first, left), "phase")
        end = in_tasks.where("last").agg(F.min("slot")).first()[0]
        path = path or temporary(spark, "path", f"{shared_folder(spark)}/places-{uuid.uuid4().hex}")
        in_tasks.where(F.col("slot") <= end).drop("last").write.mode("append").parquet(path)
        for r in in_tasks.where(F.col("slot") <= end).groupBy("_source").agg(F.count("*").alias("n")).collect():
            done[r["_source"]] += r["n"]
        phase += 1
    if path:
        frames.append(spark.read.schema(schema).parquet(path))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def long_phase(spark: SparkSession, phase: int, start: int, rates: dict[str, int], first: dict[str, int], left: dict[str, int]) -> DataFrame:
    """Rows of ``places`` for one phase, and ``last``: whether the source has run out with that block. It goes on to the
    last slot that the phase may have; what comes after the first row with ``last`` is not part of it."""
    names, length, piece, warm = sorted(rates), bound(left, rates), PIECE, WARM
    steps = lambda k: min(piece, length - k * piece)
    state = "part long, start array<long>, finish array<long>"

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, begin in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                served = dict(zip(names, begin, strict=True)) if begin else guess(rates, k * piece, warm)
                after = advanced(rates, k * piece, served, steps(k), exact=False)
                made = [[k], [[served[s] for s in names]], [[after[s] for s in names]]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)], ["part", "start", "finish"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, begin in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = islice(phase_rows(phase, start, k * piece, rates, dict(zip(names, begin, strict=True)), first), steps(k))
                while run := list(islice(rows, ROWS)):
                    columns = [*zip(*run, strict=True), [b == first[s] + left[s] - 1 for _, s, b, _, _ in run]]
                    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], ["phase", "_source", "block", "slot", "lag", "last"])

    count = -(-length // piece)
    ranges = spark.range(0, count, 1, count).select(F.col("id").alias("part"), F.lit(None).cast("array<long>").alias("start"))
    ranges = settle(ranges.mapInArrow(walked, state), "ranges")
    while True:
        before = ranges.select((F.col("part") + 1).alias("part"), F.col("finish").alias("reached"))
        wrong = settle(ranges.join(before, "part").where("start <> reached").select("part", F.col("reached").alias("start")), "wrong")
        if wrong.isEmpty():
            break
        again = wrong.repartitionByRange(min(count, MAX_TASKS), "part").mapInArrow(walked, state)
        ranges = settle(ranges.join(wrong.select("part"), "part", "left_anti").unionByName(again), "ranges")
    return ranges.select("part", "start").repartitionByRange(min(count, MAX_TASKS), "part").mapInArrow(written, "phase int, _source string, block long, slot long, lag double, last boolean")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` in the order of the mix: partitions and rows follow the slots."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ADDED}
    placed = schedule(docs.withColumnsRenamed(aside), weights, block).repartitionByRange(parts, "slot", "_rank").sortWithinPartitions("slot", "_rank")
    return placed.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select("doc_id", "source", "block", "slot", "phase", F.round("lag", 6).alias("lag"))
