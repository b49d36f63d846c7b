"""The k nearest centres of points, exactly, over partitions that follow the centres.

A bounded sample of the centres is cut at medians into the leaves of a tree, so that dense regions have small leaves. A
point's k-th nearest sampled centre within its leaf bounds how far its nearest centres can be: the point goes to the
leaves that this ball touches (its own, and across a border those on the other side), and the k best of each are merged.
A leaf's points are dealt out by a hash over as many blocks as their count asks for, its centres go to each of these
blocks; so a region with most of the points takes many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.storage import settle

#: Centres a leaf is aimed at, sampled ones among them, leaves at most; points of a block; distances worked out at once.
LEAF, SAMPLED, LEAVES, BLOCK, AT_ONCE = 4_096, 8, 1 << 14, 8_192, 1 << 21
SEED = 42


@dataclass
class Tree:
    """Node 1 is the root and 2n, 2n + 1 are n's halves: up to ``at`` along ``axis``, and beyond. Leaves are numbered from
    2 ** depth; ``sample`` holds the sampled centres by leaf."""

    depth: int
    axis: np.ndarray
    at: np.ndarray
    sample: list[np.ndarray]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node

    def touched(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for the leaves within ``bound`` of each row of x: what lies beyond a cut is as far as the cut."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        gap = np.zeros((len(x), x.shape[1]))
        for _ in range(self.depth):
            axis = self.axis[node]
            off = x[row, axis] - self.at[node]
            far = gap.copy()
            far[np.arange(len(row)), axis] = np.maximum(np.abs(off), far[np.arange(len(row)), axis])
            keep = (far * far).sum(axis=1) <= bound[row] ** 2 * (1 + 1e-9)
            near, other = 2 * node + (off > 0), 2 * node + (off <= 0)
            row, node, gap = np.concatenate([row, row[keep]]), np.concatenate([near, other[keep]]), np.concatenate([gap, far[keep]])
        return row, node


def grown(x: np.ndarray, depth: int, least: int = 1) -> Tree:
    """The tree of sampled centres x. A leaf with fewer than ``least`` of them borrows from the lowest node above that has
    as many."""
    axis, at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    parts = {1: x}
    for node in range(1, 1 << depth):
        own = parts[node]
        k = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        cut = float(np.median(own[:, k])) if len(own) else 0.0
        axis[node], at[node] = k, cut
        parts[2 * node], parts[2 * node + 1] = own[own[:, k] <= cut], own[own[:, k] > cut]
    lent = []
    for node in range(1 << depth, 2 << depth):
        while len(parts[node]) < least and node > 1:
            node //= 2
        lent.append(parts[node][: max(least, 4 * SAMPLED)])
    return Tree(depth, axis, at, lent)


def best(p: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, id, distance) of the k nearest of q (in ascending order of ids) to each of p; ties to the smaller id."""
    out = []
    step = max(1, AT_ONCE // max(1, len(q)))
    for s in range(0, len(p), step):
        d = np.zeros((min(step, len(p) - s), len(q)))
        for c in range(p.shape[1]):
            d += (p[s : s + step, c, None] - q[None, :, c]) ** 2
        d = np.sqrt(d)
        bar = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(q) else np.full((len(d), 1), np.inf)
        row, col = np.nonzero(d <= bar)
        order = np.lexsort((col, d[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        out.append((row + s, ids[col], d[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def columns(batch, *names: str) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names]) if batch.num_rows else np.zeros((0, len(names)))


def nearest_centres(points: DataFrame, centres: DataFrame, k: int = 1) -> DataFrame:
    """(vid, rank, coarse_id, dist): for points (vid, x, y, z) the k nearest centres (coarse_id, x, y, z), rank 1 the
    nearest, ties to the smaller id; all centres if there are fewer. Rows with a null take no part."""
    spark = points.sparkSession
    where = "x is not null and y is not null and z is not null"
    points, centres = points.select("vid", "x", "y", "z").where(where), centres.select("coarse_id", "x", "y", "z").where(where)
    n = centres.count()
    depth = max(0, int(np.log2(max(1, min(LEAVES, n // LEAF)))))
    few = (1 << depth) * SAMPLED * 4
    mark = F.pmod(F.xxhash64("coarse_id", F.lit(SEED)), F.lit(1 << 32))
    bar = (1 << 32) if n <= few else int((1 << 32) * 1.3 * few / n) + 1
    sample = centres.where(mark < bar).orderBy(mark, "coarse_id").limit(few).select("x", "y", "z").toArrow()
    tree = grown(np.column_stack([sample.column(a).to_numpy() for a in "xyz"]) if sample.num_rows else np.zeros((0, 3)), depth, k)
    shared = spark.sparkContext.broadcast(tree)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(s, 1 << 14)
                x = columns(part, "x", "y", "z")
                home, bound = tree.leaves(x), np.full(len(x), np.inf)
                order = np.argsort(home, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                    own = tree.sample[home[rows[0]] - (1 << tree.depth)] if len(rows) else np.zeros((0, 3))
                    if len(own) >= k:
                        row, _, d = best(x[rows], np.arange(len(own)), own, k)
                        bound[rows] = np.maximum.reduceat(d, np.flatnonzero(np.diff(row, prepend=-1)))
                row, leaf = tree.touched(x, bound)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(leaf)], names=["vid", "x", "y", "z", "leaf"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaves(columns(batch, "x", "y", "z")))], names=["coarse_id", "x", "y", "z", "leaf"])

    met = settle(points.mapInArrow(sent, "vid long, x double, y double, z double, leaf long"), "nearest-points")
    held = centres.mapInArrow(placed, "coarse_id long, x double, y double, z double, leaf long")
    blocks = met.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a leaf, LEAVES at most
    left = met.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).drop("blocks")
    right = held.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(p: pa.Table, c: pa.Table) -> pa.Table:
        made = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if p.num_rows and c.num_rows:
            c = c.sort_by("coarse_id")
            row, ids, d = best(columns(p, "x", "y", "z"), c.column("coarse_id").to_numpy(), columns(c, "x", "y", "z"), k)
            made = (p.column("vid").to_numpy()[row], ids, d)
        return pa.table({n: pa.array(v) for n, v in zip(("vid", "coarse_id", "dist"), made, strict=True)})

    found = left.groupBy("leaf", "block").cogroup(right.groupBy("leaf", "block")).applyInArrow(run, "vid long, coarse_id long, dist double")
    top = found.groupBy("vid").agg(F.slice(F.array_sort(F.collect_set(F.struct("dist", "coarse_id"))), 1, k).alias("top"))
    return top.select("vid", F.posexplode("top").alias("rank", "hit")).select("vid", (F.col("rank") + 1).alias("rank"), "hit.coarse_id", "hit.dist")
