"""Sparse matrices (i, j, v) and vectors (i, v) as relations; zero entries may be absent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators.prolong import met
from meshframe.storage import settle

#: Blocks of rows of a product at least, the entries that a block has, products at one time, and entries of columns taken at once.
GRID, CELL, STEP, TAKEN = 16, 2_000_000, 2_000_000, 100_000


def reduce_entries(entries: DataFrame) -> DataFrame:
    """Duplicate entries summed; partial sums precede the shuffle."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    held = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return a.join(held, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def spmm_in_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """``spmm`` for inner indices with many entries on both sides, such as hubs: the entries of an index are counted on
    either side, and its products are spread over a grid of blocks instead of one partition."""
    products = met(a.select(F.col("i").alias("f"), F.col("j").alias("c"), "v"), b.select(F.col("i").alias("c"), "j", F.col("v").alias("w")))
    return products.groupBy(F.col("f").alias("i"), "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def product_row_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, n_entries, sum_squares): the entries of each row of a b and the sum of their squares, without moving a product.

    ``a`` is cut into blocks of neighbouring rows of about CELL entries, GRID at least. To each block go the rows of ``b``
    that its entries name, and no others; a task holds a block's entries and takes the columns of ``b`` one after the other as
    they stream by. It has all terms of its rows, so that only a count and a sum of each row leave it. ``b`` moves once for
    each block that needs a row: about once where ids lie near those of their neighbours, never more often than the
    products are or the blocks."""
    blocks = max(GRID, -(-a.count() // CELL))
    dealt = settle(a.select("i", "j", "v").repartitionByRange(blocks, "i").withColumn("p", F.spark_partition_id()), "rows")
    needed = dealt.select("p", F.col("j").alias("i")).distinct()
    rows = dealt.select("p", F.lit(None).cast("long").alias("at"), F.col("j").alias("k"), "v", "i")
    columns = b.select("i", "j", "v").join(needed, "i").select("p", F.col("j").alias("at"), F.col("i").alias("k"), "v", F.lit(None).cast("long").alias("i"))
    both = rows.unionByName(columns).repartitionById(blocks, F.col("p")).sortWithinPartitions("at")  # one long to sort by: the block's rows, then columns
    made = both.select("at", "k", "v", "i").mapInArrow(row_sums_of_block, "i long, n_entries long, sum_squares double")
    return made.where("n_entries > 0")


class Rows:
    """The rows (at, k, v) of a block, in the order of their inner index, and what has been added up for each."""

    def __init__(self, at: np.ndarray, k: np.ndarray, v: np.ndarray):
        self.top, own = np.unique(at, return_inverse=True)
        order = np.argsort(k, kind="stable")
        self.k, self.v, self.own = k[order], v[order], own[order]
        self.counts, self.squares = np.zeros(len(self.top), np.int64), np.zeros(len(self.top))

    def take(self, at: np.ndarray, k: np.ndarray, w: np.ndarray) -> None:
        """Multiply whole columns (at, k, w), which stand side by side, some STEP products at a time."""
        first = np.searchsorted(self.k, k, "left")
        many = np.searchsorted(self.k, k, "right") - first
        ends = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        before = np.concatenate([[0], np.cumsum(many)])
        load = before[ends]
        low = 0
        while low < len(ends) - 1:
            high = max(low + 1, int(np.searchsorted(load, load[low] + STEP, "right")) - 1)
            if load[high] - load[low] > STEP:
                self.take_long(first, many, w, before, ends[low], ends[high])
            elif load[high] > load[low]:
                part = slice(ends[low], ends[high])
                row, term = self.terms(first[part], many[part], w[part])
                column = np.repeat(np.arange(high - low), load[low + 1 : high + 1] - load[low:high])
                self.add(column * len(self.top) + row, term)
            low = high

    def terms(self, first: np.ndarray, many: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        return self.own[hit], self.v[hit] * np.repeat(w, many)

    def add(self, key: np.ndarray, term: np.ndarray) -> None:
        turn = np.argsort(key)
        key = key[turn]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums, own = np.add.reduceat(term[turn], starts), key[starts] % len(self.top)
        self.counts += np.bincount(own, minlength=len(self.top))
        self.squares += np.bincount(own, sums * sums, minlength=len(self.top))

    def take_long(self, first: np.ndarray, many: np.ndarray, w: np.ndarray, before: np.ndarray, low: int, high: int) -> None:
        """One column of more than STEP products: a sum for every row, over parts of the column."""
        sums, seen = np.zeros(len(self.top)), np.zeros(len(self.top), bool)
        while low < high:
            to = min(high, max(low + 1, int(np.searchsorted(before, before[low] + STEP, "right")) - 1))
            row, term = self.terms(first[low:to], many[low:to], w[low:to])
            sums += np.bincount(row, term, minlength=len(self.top))
            seen[row] = True
            low = to
        self.counts += seen
        self.squares += np.where(seen, sums * sums, 0.0)


def row_sums_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (at, k, v, i): those of a block's rows i, whose ``at`` is null, then those of the columns ``at`` that it is
    multiplied by, ascending. The last column of what has come is kept back until it is known to be whole."""
    held, kept, n, rows = [], [], 0, None
    joined = lambda parts: tuple(np.concatenate([c.to_numpy(zero_copy_only=False) for c in x]) for x in zip(*parts, strict=True))
    for batch in batches:
        own = batch["at"].null_count
        if own:
            held.append((batch["i"][:own], batch["k"][:own], batch["v"][:own]))
        if own == len(batch):
            continue
        if rows is None:
            rows, held = Rows(*joined(held)), []
        kept.append((batch["at"][own:], batch["k"][own:], batch["v"][own:]))
        n += len(batch) - own
        if n >= TAKEN and kept[0][0][0] != batch["at"][-1]:
            at, k, w = joined(kept)
            last = int(np.searchsorted(at, at[-1], "left"))
            rows.take(at[:last], k[:last], w[:last])
            kept, n = [tuple(pa.array(x[last:]) for x in (at, k, w))], len(at) - last
    if rows is not None:
        rows.take(*joined(kept))
        yield pa.RecordBatch.from_pydict({"i": rows.top, "n_entries": rows.counts, "sum_squares": rows.squares})


def galerkin(a: DataFrame, p: DataFrame) -> DataFrame:
    """P^T (A P); the inner product first, since it is the smaller one."""
    return spmm(transpose(p), spmm(a, p))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha a + beta b, matrices or vectors."""
    keys = [c for c in a.columns if c != "v"]
    scaled = lambda m, s: m.select(*keys, (F.col("v") * s).alias("v"))
    return scaled(a, alpha).unionByName(scaled(b, beta)).groupBy(*keys).agg(F.sum("v").alias("v"))


def scale_rows(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d.select("i", F.col("v").alias("_d")), "i").select("i", "j", (F.col("v") * F.col("_d")).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def inverse_diagonal(a: DataFrame, n: DataFrame, epsilon: float = 1e-14) -> DataFrame:
    """(i, v) for the rows ``n`` (i): 1 over the diagonal entry, 0 where that is missing or tiny."""
    return n.select("i").join(diagonal(a), "i", "left").select("i", G.safe_inverse(F.coalesce("v", F.lit(0.0)), epsilon).alias("v"))


def zero_diagonals(a: DataFrame, n: DataFrame, epsilon: float = 1e-14) -> DataFrame:
    return n.select("i").join(diagonal(a), "i", "left").agg(F.count_if(F.col("v").isNull() | (F.abs("v") < epsilon)).alias("n_zero"))


def norm(x: DataFrame, mass_inverse: DataFrame | None = None) -> DataFrame:
    """One row: the norm of a vector, weighted by ``mass_inverse`` where given."""
    square = F.col("v") * F.col("v")
    if mass_inverse is not None:
        x, square = x.join(mass_inverse.select("i", F.col("v").alias("_m")), "i"), F.col("v") * F.col("v") * F.col("_m")
    return x.agg(F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.sum(square), F.lit(0.0)))).alias("norm"))


def relative_norm(x: DataFrame, y: DataFrame) -> DataFrame:
    """|x - y| / max(|y|, 1e-30)."""
    gap = add(x, y, 1.0, -1.0)
    return norm(gap).withColumnRenamed("norm", "gap").crossJoin(norm(y)).select((F.col("gap") / F.greatest("norm", F.lit(1e-30))).alias("relative"))


def jacobi_sweep(a: DataFrame, b: DataFrame, x: DataFrame, d_inverse: DataFrame, omega: float) -> DataFrame:
    """x + omega D^-1 (b - A x)."""
    return add(x, scaled(add(b, spmv(a, x), 1.0, -1.0), d_inverse), 1.0, omega)


def row_sums(p: DataFrame) -> DataFrame:
    return p.groupBy("i").agg(F.sum("v").alias("total"))


def partition_of_unity(p: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: the worst row sum's distance from 1, its row, and how many are off."""
    off = row_sums(p).withColumn("off", F.abs(F.col("total") - 1))
    return off.agg(F.max("off").alias("worst"), F.min_by("i", F.struct(-F.col("off"), F.col("i"))).alias("row"), F.count_if(F.col("off") > tolerance).alias("n_off"))


def negative_entries(p: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    low = F.min(F.struct("v", "i", "j"))
    return p.agg(F.count_if(F.col("v") < -tolerance).alias("n_negative"), low["v"].alias("least"), low["i"].alias("i"), low["j"].alias("j"))


def check_prolongation(p: DataFrame, n_fine: int, n_coarse: int, tolerance: float = 1e-10) -> dict[str, bool]:
    """The invariants of an interpolation matrix."""
    box = p.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.count_distinct("i").alias("rows")).first()
    unity, low = partition_of_unity(p, tolerance).first(), negative_entries(p).first()
    return {"shape": (box.i or 0) < n_fine and (box.j or 0) < n_coarse, "rows": box.rows == n_fine, "unity": not unity.n_off, "positive": not low.n_negative, "constants": (unity.worst or 0.0) <= tolerance}


def power_growth(a: DataFrame, x: DataFrame, steps: int = 2) -> DataFrame:
    """One row: the growth of the norm in the last of ``steps`` power steps x <- D^-1 A x."""
    d = settle(inverse_diagonal(a, x), "diagonal")
    before = x
    for _ in range(steps):
        before, x = x, settle(scaled(spmv(a, x), d), "power")
    return norm(x).withColumnRenamed("norm", "top").crossJoin(norm(before)).select(F.try_divide("top", "norm").alias("growth"))


def scaled(x: DataFrame, d: DataFrame) -> DataFrame:
    """(i, v): a vector times a diagonal."""
    return x.join(d.select("i", F.col("v").alias("_d")), "i").select("i", (F.col("v") * F.col("_d")).alias("v"))
