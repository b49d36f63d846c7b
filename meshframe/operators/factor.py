"""Sparse LDL^T factors of symmetric matrices (i, j, v) by nested dissection, as relations.

``dissect`` cuts the rows by coordinates: each part is split at its median along one axis, and the rows of the lower
half that have an entry with the upper half become its separator, so that the rest of both halves shares no entry. Parts
and separators are the nodes of a binary tree (1 the root, 2k and 2k + 1 the halves of k). ``factorise`` goes up the
tree: the fronts of a depth are eliminated side by side, one task a front, and what they add to the rows of their
ancestors (their Schur complements) is summed over the cluster before the next depth. ``solve`` carries a right side up
and the solution down the same tree.

A front holds a part's rows and those of its ancestors that it meets, as a dense block: (own + met)^2 doubles, which
FRONT bounds by raising an error. The number of rounds is twice the depth, known beforehand; there is no iteration that
could go on. A pivot under EPSILON of the front's largest diagonal entry raises."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from meshframe.storage import settle

#: Rows that a leaf is aimed at, rows that a front may have at most, and the least pivot.
LEAF, FRONT, EPSILON = 384, 12_000, 1e-13
#: Fronts of one file of factors: readers take rows by the thousand, whatever their arrays hold.
TOGETHER = 32
FACTORS = "node long, own array<long>, met array<long>, d array<double>, low array<double>"


@dataclass
class Factors:
    """``nodes`` (i, node) says where each row is eliminated; ``fronts`` by depth from the leaves, as FACTORS: the
    pivots d and the columns of L over own and met rows, one after the other."""

    nodes: DataFrame
    fronts: list[DataFrame]
    n: int


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that aren't broadcast. Its files are small beside its rows, since ids, nodes and flags compress
    well: under the threshold for a broadcast they would go through the driver whole, several times a depth."""
    return df.hint("merge")


def side_by_side(df: DataFrame, depth: int) -> GroupedData:
    """``df`` by node, over partitions of about TOGETHER of the nodes at ``depth``. Their number is set, since shuffles of a front's
    rows or entries are small beside what it makes of them and would be merged."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(1 << depth) // TOGETHER)) if depth else 1
    return df.repartition(min(parts, 1 << depth), "node").groupBy("node")


def depth_for(n: int) -> int:
    depth = 0
    while n >> depth > LEAF:
        depth += 1
    return depth


def dissect(a: DataFrame, places: DataFrame, depth: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(i, node): the tree node of each row of ``places`` (i and the axes). A row without coordinates goes to the lower
    half. Medians are those of each part alone; a part of one row isn't cut."""
    nodes = places.select("i", *axes, F.lit(1).cast("long").alias("node"), F.lit(False).alias("fixed"))
    links = settle(a.where("i <> j and v <> 0").select("i", "j"), "links") if depth else a
    for k in range(depth):
        # the axis along which the part is longest
        live = nodes.where(~F.col("fixed"))
        span = F.array(*[F.struct((F.max(x) - F.min(x)).alias("w"), F.lit(-n).alias("n")) for n, x in enumerate(axes)])
        cuts = live.groupBy("node").agg(F.array_max(span)["n"].alias("axis"), *[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{x}") for x in axes])
        value = F.coalesce(*[F.when(F.col("axis") == -n, F.col(x) - F.col(f"m_{x}")) for n, x in enumerate(axes)], F.lit(0.0))
        sided = nodes.join(cuts, "node", "left").withColumn("upper", (~F.col("fixed")) & (value > 0))
        sided = settle(sided.select("i", *axes, "node", "fixed", "upper"), "sides")
        end = lambda c, s: sided.where(~F.col("fixed")).select(F.col("i").alias(c), F.col("node").alias(f"{s}_node"), F.col("upper").alias(f"{s}_upper"))
        crossing = links.join(apart(end("i", "a").where("not a_upper")), "i").join(apart(end("j", "b").where("b_upper")), "j").where("a_node = b_node").select("i").distinct().withColumn("cut", F.lit(True))
        half = F.when(F.col("fixed") | F.col("cut"), F.col("node")).otherwise(F.col("node") * 2 + F.col("upper").cast("long"))
        nodes = settle(sided.join(apart(crossing), "i", "left").select("i", *axes, half.alias("node"), (F.col("fixed") | F.coalesce("cut", F.lit(False))).alias("fixed")), "nodes")
    return nodes.select("i", "node")


def dense(own: np.ndarray, met: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
    ids = np.concatenate([own, met])
    if len(ids) > FRONT:
        raise ValueError(f"a front has {len(ids)} rows, over {FRONT}: the matrix has no small separators along its coordinates")
    order = np.argsort(ids, kind="stable")
    at = lambda x: order[np.searchsorted(ids, x, sorter=order)]
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (at(i), at(j)), v)
    return out


def eliminated(front: np.ndarray, n: int, width: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, L, rest): the first n rows of a symmetric front eliminated in panels; L has unit diagonal."""
    size = max(1e-300, float(np.abs(np.diagonal(front)[:n]).max(initial=0)))
    low, d = np.zeros((len(front), n)), np.zeros(n)
    for at in range(0, n, width):
        to = min(n, at + width)
        for k in range(at, to):
            column = front[k:, k] - low[k:, at:k] @ (low[k, at:k] * d[at:k])
            if not abs(column[0]) > EPSILON * size:
                raise ValueError("a pivot is zero: the matrix can't be factorised")
            d[k], low[k:, k] = column[0], column / column[0]
        front[to:, to:] -= (low[to:, at:to] * d[at:to]) @ low[to:, at:to].T
    return d, low, front[n:, n:]


def factorise(a: DataFrame, places: DataFrame, depth: int | None = None) -> Factors:
    """Factors of the symmetric ``a`` whose rows are those of ``places`` (i, x, y, z)."""
    n = places.count()
    depth = depth_for(n) if depth is None else depth
    nodes = settle(dissect(a, places, depth), "dissection")
    name = lambda k: apart(nodes.select(F.col("i").alias(k), F.col("node").alias(f"n{k}")))
    # an entry is held by the deeper of its rows' nodes; the two are one or stand above each other
    left = settle(a.join(name("i"), "i").join(name("j"), "j").select("i", "j", "v", F.greatest("ni", "nj").alias("node"), (F.col("ni") >= F.col("nj")).alias("row"), (F.col("nj") >= F.col("ni")).alias("col")), "entries")
    rows = nodes.select("node", F.col("i").alias("own"))
    fronts = []
    for k in range(depth, -1, -1):
        inside = (F.col("node") >= 1 << k) & (F.col("node") < 1 << (k + 1))
        held = left.where(inside).groupBy("node", "i", "j", "row", "col").agg(F.sum("v").alias("v"))
        made = settle(side_by_side(rows.where(inside), k).cogroup(side_by_side(held, k)).applyInArrow(front_of, FACTORS + ", ui array<long>, uj array<long>, uv array<double>"), "front")
        fronts.append(made.drop("ui", "uj", "uv"))
        if k:
            updates = made.select(F.inline(F.arrays_zip(F.col("ui").alias("i"), F.col("uj").alias("j"), F.col("uv").alias("v"))))
            up = updates.groupBy("i", "j").agg(F.sum("v").alias("v")).join(name("i"), "i").join(name("j"), "j")
            up = up.select("i", "j", "v", F.greatest("ni", "nj").alias("node"), (F.col("ni") >= F.col("nj")).alias("row"), (F.col("nj") >= F.col("ni")).alias("col"))
            left = settle(left.where(F.col("node") < 1 << k).unionByName(up), "entries")
    return Factors(nodes, fronts, n)


def front_of(rows: pa.Table, entries: pa.Table) -> pa.Table:
    """One front as a FACTORS row with its update (ui, uj, uv)."""
    if not rows.num_rows:
        return pa.table({}) if not entries.num_rows else pa.Table.from_pylist([])
    own = np.sort(rows.column("own").to_numpy())
    i, j, v, r, c = (entries.column(k).to_numpy() if entries.num_rows else np.zeros(0, t) for k, t in (("i", np.int64), ("j", np.int64), ("v", float), ("row", bool), ("col", bool)))
    met = np.setdiff1d(np.concatenate([i[~r], j[~c]]), own)
    d, low, rest = eliminated(dense(own, met, i, j, v), len(own))
    ui, uj = np.nonzero(rest)
    node = rows.column("node")[0].as_py()
    columns = {"node": [node], "own": [own], "met": [met], "d": [d], "low": [low.ravel(order="F")], "ui": [met[ui]], "uj": [met[uj]], "uv": [rest[ui, uj]]}
    kinds = {"node": pa.int64(), "d": pa.list_(pa.float64()), "low": pa.list_(pa.float64()), "uv": pa.list_(pa.float64())}
    return pa.table({k: pa.array(x, kinds.get(k, pa.list_(pa.int64()))) for k, x in columns.items()})


def lower_of(front: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, met = (np.asarray(front[k], np.int64) for k in ("own", "met"))
    return own, met, np.asarray(front["low"]).reshape(len(own), -1).T


def stepped(step: Callable[[dict, dict[int, float]], list[tuple[int, float]]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogroup's function: the front with the values (i, v) of its rows to values (i, v)."""

    def run(front: pa.Table, values: pa.Table) -> pa.Table:
        made: list[tuple[int, float]] = []
        for f in front.to_pylist():
            made += step(f, dict(zip(values.column("i").to_pylist(), values.column("v").to_pylist(), strict=True)))
        return pa.table({"i": pa.array([m[0] for m in made], pa.int64()), "v": pa.array([m[1] for m in made], pa.float64()), "own": pa.array([m[2] for m in made], pa.bool_())})

    return run


def forward(front: dict, values: dict[int, float]) -> Iterator:
    """L y = b over own rows, and what y takes off the rows met."""
    own, met, low = lower_of(front)
    y = np.array([values.get(i, 0.0) for i in own.tolist()])
    n = len(own)
    for k in range(n):
        y[k + 1 :] -= low[k + 1 : n, k] * y[k]
    taken = -(low[n:] * y).sum(axis=1)
    return [*zip(own.tolist(), (y / np.asarray(front["d"])).tolist(), [True] * n), *zip(met.tolist(), taken.tolist(), [False] * len(met))]


def backward(front: dict, values: dict[int, float]) -> Iterator:
    """L^T x = z over own rows, the rows met being known."""
    own, met, low = lower_of(front)
    n = len(own)
    x = np.array([values.get(i, 0.0) for i in own.tolist()]) - (low[n:] * np.array([values.get(i, 0.0) for i in met.tolist()])[:, None]).sum(axis=0)
    for k in range(n - 1, -1, -1):
        x[k] -= (low[k + 1 : n, k] * x[k + 1 :]).sum()
    return list(zip(own.tolist(), x.tolist(), [True] * n))


def solve(f: Factors, b: DataFrame) -> DataFrame:
    """(i, v): the solution for the right side ``b`` (i, v); rows that it lacks are zero."""
    kinds = "i long, v double, own boolean"
    known = None
    right = f.nodes.join(apart(b.select("i", "v")), "i", "left").select("i", "node", F.coalesce("v", F.lit(0.0)).alias("v"))
    top = len(f.fronts) - 1
    for k, front in enumerate(f.fronts):
        inside = F.col("node") >= 1 << (top - k)
        made = settle(side_by_side(front, top - k).cogroup(side_by_side(right.where(inside), top - k)).applyInArrow(stepped(forward), kinds), "forward")
        done = made.where("own").select("i", "v")
        known = done if known is None else known.unionByName(done)
        if k < top:
            taken = made.where("not own").groupBy("i").agg(F.sum("v").alias("off"))
            right = right.where(~inside).join(apart(taken), "i", "left").select("i", "node", (F.col("v") + F.coalesce("off", F.lit(0.0))).alias("v"))
            right = settle(right, "right")
    z = known
    solved = None
    for k, front in enumerate(reversed(f.fronts)):
        own = front.select("node", F.explode("own").alias("i")).join(apart(z), "i")
        values = own
        if solved is not None:
            values = own.unionByName(front.select("node", F.explode("met").alias("i")).join(apart(solved), "i"))
        values = settle(values, "values")  # a relation of its own beside the front
        made = side_by_side(front, k).cogroup(side_by_side(values, k)).applyInArrow(stepped(backward), kinds).select("i", "v")
        solved = settle(made if solved is None else solved.unionByName(made), "solution")
    return solved
