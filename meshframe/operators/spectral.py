"""The largest eigenvalue of D^-1 A, which sets the smoother's weights."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.operators import sparse
from meshframe.storage import bucketed, forget, settle

# Steps and safety factor of the estimate.
STEPS, SAFETY = 50, 1.20
SEED = 7
#: Rows that a block of Lanczos vectors is aimed at.
BLOCK = 32_768


def largest_of_tridiagonal(alpha: list[float], beta: list[float]) -> float:
    """The largest eigenvalue of the symmetric tridiagonal matrix, by bisection on the signs of its pivots."""
    reach = max(abs(a) + abs(b) + abs(c) for a, b, c in zip(alpha, [0.0, *beta], [*beta, 0.0], strict=False))
    low, high = -reach, reach
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        pivot, below = 1.0, 0
        for a, b in zip(alpha, [0.0, *beta], strict=False):
            pivot = a - mid - b * b / pivot
            pivot = pivot or -1e-300
            below += pivot < 0
        low, high = (low, mid) if below == len(alpha) else (mid, high)
    return high


def lanczos(a: DataFrame, rows: DataFrame, steps: int = STEPS) -> tuple[list[float], list[float]]:
    """Coefficients (alpha, beta) of the recurrence on D^-1/2 A D^-1/2, which has the eigenvalues of D^-1 A, from a start
    that is drawn by a hash of the row. ``a`` (i, j, v) must be symmetric with a positive diagonal; rows (i) without one
    don't take part.

    Rows are dealt into blocks by their ids (``block_of``); a row of the tables below is a block of the vectors or the matrix's
    entries between two blocks. A step is one job with one exchange: the scaled matrix lies in the partitions of its column
    blocks, the vectors in those of theirs, and what moves is one sum for each row and column block that has entries in it. It
    writes v and u = A v - beta v', and observes u.v and u.u meanwhile; the next vector (u - alpha v) / beta is worked out as
    it is read, its length being u.u - alpha^2."""
    spark = a.sparkSession
    root = settle(sparse.diagonal(a).where("v > 0").select("i", F.sqrt("v").alias("s")), "roots")
    live = rows.join(root.hint("merge"), "i", "left_semi").distinct()
    at = block_of(live)
    both = a.join(root.hint("merge"), "i").join(root.select(F.col("i").alias("j"), F.col("s").alias("t")).hint("merge"), "j")
    entries = both.select(at("j").alias("b"), at("i").alias("to"), "i", "j", (F.col("v") / (F.col("s") * F.col("t"))).alias("v"))
    lists = entries.groupBy("b", "to").agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
    scaled, held = bucketed(lists.select("b", "to", *[F.col(f"e.{c}").alias(c) for c in "ijv"]), "b", "scaled")
    draw = (F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(2001)) - 1000) / 1000.0 + 0.0005
    start = live.select(at("i").alias("b"), F.struct("i", draw.alias("u")).alias("e")).groupBy("b").agg(F.array_sort(F.collect_list("e")).alias("e"))
    state, own = bucketed(start.select("b", F.col("e.i").alias("i"), F.transform("e", lambda _: F.lit(0.0)).alias("v"), F.col("e.u").alias("u")), "b", "lanczos")
    first = state.select(F.explode("u").alias("u")).agg(F.sum(F.col("u") * F.col("u")).alias("s")).first().s
    alpha, beta, off, size = [], [], 0.0, math.sqrt(first or 0.0)
    for k in range(steps):
        if size < 1e-12:
            break
        parts = scaled.groupBy("b").cogroup(state.groupBy("b")).applyInArrow(partial_sums(off, size), "b long, i array<long>, ax array<double>")
        after = state.groupBy("b").cogroup(parts.groupBy("b")).applyInArrow(stepped(off, size, size if k else 0.0), "b long, i array<long>, v array<double>, u array<double>, uv double, uu double")
        seen = Observation(f"lanczos {k}")
        state, path = bucketed(after.observe(seen, F.sum("uv").alias("uv"), F.sum("uu").alias("uu")).drop("uv", "uu"), "b", "lanczos")
        forget(spark, *own)
        own, off = path, seen.get["uv"]
        alpha.append(off)
        size = math.sqrt(max(0.0, seen.get["uu"] - off * off))
        beta.append(size)
    forget(spark, *own, *held)
    return alpha, beta[:-1]


def block_of(rows: DataFrame) -> Callable[[str], Column]:
    """The block of a row's id: neighbouring ids share one, BLOCK rows a block on average where ids are spread evenly; ids spread
    otherwise are cut by hash where a block of neighbours would hold over eight times that."""
    box = rows.agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high")).first()
    blocks = max(1, -(-box.n // BLOCK))
    width = max(1, -(-((box.high or 0) - (box.low or 0) + 1) // blocks))
    near = lambda c: F.floor((F.col(c) - F.lit(box.low or 0)) / width).cast("long")
    most = rows.groupBy(near("i").alias("b")).count().agg(F.max("count").alias("most")).first().most or 0
    return near if most <= 8 * BLOCK else lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))


def flat(t: pa.Table, name: str) -> np.ndarray:
    """The lists of a column, one after the other."""
    column = t.column(name).combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False)


def partial_sums(off: float, size: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogroup's function: the entries of a column block with its vectors to (b, i, ax), a row for each block of rows."""

    def run(entries: pa.Table, state: pa.Table) -> pa.Table:
        out: dict[str, list] = {"b": [], "i": [], "ax": []}
        if entries.num_rows and state.num_rows:
            ids = flat(state, "i")
            x = (flat(state, "u") - off * flat(state, "v")) / size
            for k in range(entries.num_rows):
                part = entries.slice(k, 1)
                i, j = flat(part, "i"), flat(part, "j")
                place = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
                terms = np.where(ids[place] == j, flat(part, "v") * x[place], 0.0)
                into, where = np.unique(i, return_inverse=True)
                out["b"].append(part.column("to")[0].as_py())
                out["i"].append(into)
                out["ax"].append(np.bincount(where, terms, len(into)))
        return pa.table({"b": pa.array(out["b"], pa.int64()), "i": pa.array(out["i"], pa.list_(pa.int64())), "ax": pa.array(out["ax"], pa.list_(pa.float64()))})

    return run


def stepped(off: float, size: float, beta: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogroup's function: a block of the vectors with the sums of its rows to the next one, with its parts of u.v and u.u."""

    def run(state: pa.Table, parts: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.table({"b": pa.array([], pa.int64()), "i": pa.array([], pa.list_(pa.int64())), **{c: pa.array([], pa.list_(pa.float64())) for c in "vu"}, **{c: pa.array([], pa.float64()) for c in ("uv", "uu")}})
        ids, before = flat(state, "i"), flat(state, "v")
        v = (flat(state, "u") - off * before) / size
        u = -beta * before
        if parts.num_rows:
            i, ax = flat(parts, "i"), flat(parts, "ax")
            place = np.minimum(np.searchsorted(ids, i), len(ids) - 1)
            u += np.bincount(place, np.where(ids[place] == i, ax, 0.0), len(ids))
        vectors = {"i": pa.array([ids], pa.list_(pa.int64())), "v": pa.array([v], pa.list_(pa.float64())), "u": pa.array([u], pa.list_(pa.float64()))}
        return pa.table({"b": pa.array([state.column("b")[0].as_py()], pa.int64()), **vectors, "uv": [float((u * v).sum())], "uu": [float((u * u).sum())]})

    return run


def largest_eigenvalue(a: DataFrame, rows: DataFrame, steps: int = STEPS, safety: float = SAFETY) -> float:
    """Of D^-1 A, with the safety factor; 0 if there are no rows."""
    alpha, beta = lanczos(a, rows, steps)
    return safety * largest_of_tridiagonal(alpha, beta) if alpha else 0.0


def row_bound(a: DataFrame) -> float:
    """An upper bound of the eigenvalues of D^-1 A: the largest sum of a row's absolute entries over its diagonal."""
    sums = a.groupBy("i").agg(F.sum(F.abs("v")).alias("all"), F.sum(F.when(F.col("i") == F.col("j"), F.abs("v"))).alias("own"))
    return sums.where("own > 1e-14").agg(F.max(F.col("all") / F.col("own")).alias("m")).first().m or 0.0
