"""V-cycles over tables: no vector is collected or sent to all tasks.

Each level's operator lies in the partitions (buckets) of its columns, its vectors in those of their rows, the
interpolation once by either end. A sweep reads operator and vector partition by partition, adds up partial products and
exchanges these, at most one for each row and task; residual and restriction are one job with two exchanges. The driver
gets a residual norm a cycle, which is observed by the job that does the first sweep of the next one. The coarsest
operator is factorised by ``operators.factor``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.functions.geometry import chebyshev_omegas
from meshframe.operators import factor, sparse, spectral
from meshframe.storage import bucketed, forget, settle

DEGREE, FALLBACK_OMEGA = 2, 0.6667


@dataclass
class Table:
    """A bucketed relation and the names under which it can be deleted."""

    df: DataFrame
    names: tuple[str, str]


def table(df: DataFrame, key: str, label: str) -> Table:
    return Table(*bucketed(df, key, label))


@dataclass
class Level:
    a: DataFrame  # by column
    rows: DataFrame  # i, d (inverse diagonal); by row
    omegas: list[float]
    down: DataFrame | None = None  # interpolation to this level's rows, by row
    up: DataFrame | None = None  # the same, by column


class TableCycle:
    """Operators of all levels of ``a`` (i, j, v, symmetric) over ``rows`` (i), from the finest. ``prolongations`` lead
    from each level to the next finer one; ``places`` (i, x, y, z) are the coarsest level's rows."""

    def __init__(self, a: DataFrame, rows: DataFrame, prolongations: list[DataFrame], places: DataFrame, bound: bool = False, steps: int = spectral.STEPS):
        if not prolongations:
            raise ValueError("a cycle needs one coarser level at least")
        self.levels: list[Level] = []
        for p in prolongations:
            own = bucketed(sparse.inverse_diagonal(a, rows).select("i", F.col("v").alias("d")), "i", "rows")[0]
            held = bucketed(a.select("i", "j", "v"), "j", "operator")[0]
            most = spectral.row_bound(held) if bound else spectral.largest_eigenvalue(held, own, steps)
            down, up = (bucketed(p.select("i", "j", "v"), k, "interpolation")[0] for k in "ij")
            self.levels.append(Level(held, own, chebyshev_omegas(most, DEGREE) if most > 1e-10 else [], down, up))
            rows = settle(p.select(F.col("j").alias("i")).distinct(), "coarse-rows")
            a = settle(sparse.galerkin(a, p), "galerkin")
        self.levels.append(Level(a, bucketed(rows.select("i", F.lit(0.0).alias("d")), "i", "rows")[0], []))
        self.factors = factor.factorise(a, rows.join(places, "i", "left"))

    def product(self, a: DataFrame, state: DataFrame, into: str = "i", other: str = "j") -> DataFrame:
        """(i, ax): entries (into, other, v) times the x of ``state``, by the rows ``into``."""
        held = state.select(F.col("i").alias(other), "x")
        return a.join(held, other).groupBy(F.col(into).alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("ax"))

    def residual(self, k: int, state: DataFrame) -> DataFrame:
        """``state`` with r = b - A x."""
        return state.join(self.product(self.levels[k].a, state), "i", "left").withColumn("r", F.col("b") - F.coalesce("ax", F.lit(0.0))).drop("ax")

    def replaced(self, old: Table, df: DataFrame, label: str = "state") -> Table:
        new = table(df, "i", label)
        forget(df.sparkSession, *old.names)
        return new

    def weight(self, k: int, s: int, omega: float) -> float:
        own = self.levels[k].omegas
        return own[s] if s < len(own) else omega

    def swept(self, k: int, state: DataFrame, w: float) -> DataFrame:
        step = F.col("x") + w * F.col("d") * F.col("r")
        return self.residual(k, state).withColumn("x", step).drop("r")

    def smooth(self, k: int, state: Table, sweeps: range, omega: float) -> Table:
        for s in sweeps:
            state = self.replaced(state, self.swept(k, state.df, self.weight(k, s, omega)))
        return state

    def below(self, k: int, state: Table, pre: int, post: int, omega: float) -> Table:
        """``state`` after pre-smoothing, corrected by the coarser levels and smoothed again."""
        level, coarse = self.levels[k], self.levels[k + 1]
        r = self.residual(k, state.df).select("i", "r")
        low = r.join(level.down, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("r")).alias("b"))
        low = coarse.rows.join(low, "i", "left").select("i", F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("b"), "d")
        step = self.solved(k + 1, low, pre, post, omega)
        moved = self.product(level.up, step.df)
        corrected = state.df.join(moved, "i", "left").withColumn("x", F.col("x") + F.coalesce("ax", F.lit(0.0))).drop("ax")
        state = self.replaced(state, corrected)
        forget(state.df.sparkSession, *step.names)
        return self.smooth(k, state, range(post), omega)

    def solved(self, k: int, low: DataFrame, pre: int, post: int, omega: float) -> Table:
        """The correction of a coarser level for right sides b, from x = 0: its first sweep needs no product."""
        if k == len(self.levels) - 1:
            right = settle(low.select("i", F.col("b").alias("v")), "coarse-right")
            return table(factor.solve(self.factors, right).select("i", F.col("v").alias("x")), "i", "coarse")
        if pre:
            low = low.withColumn("x", self.weight(k, 0, omega) * F.col("d") * F.col("b"))
        state = self.smooth(k, table(low, "i", "state"), range(1, pre), omega)
        return self.below(k, state, pre, post, omega)

    def solve(self, b: DataFrame, x: DataFrame | None = None, max_cycles: int = 150, tolerance: float = 1e-8, pre: int = 2, post: int = 2, omega: float = FALLBACK_OMEGA, mass_inverse: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
        """(solution (i, v), residual norms from the start on), until a norm falls under ``tolerance`` times the first
        one, for ``max_cycles`` at most. Right sides and starts without a row count as zero; ``mass_inverse`` (i, v)
        weighs the norm."""
        if pre < 1:
            raise ValueError("the norm is observed by the first sweep: pre must be 1 or more")
        part = lambda df, name, missing: df.select("i", F.col("v").alias(name)) if df is not None else self.levels[0].rows.select("i", F.lit(missing).alias(name))
        start = self.levels[0].rows
        for df, name, missing in ((x, "x", 0.0), (b, "b", 0.0), (mass_inverse, "m", 1.0)):
            start = start.join(part(df, name, missing), "i", "left").withColumn(name, F.coalesce(name, F.lit(missing if df is None else 0.0)))
        state, norms = table(start.select("i", "x", "b", "d", "m"), "i", "state"), []
        while True:
            seen = Observation(f"residual {len(norms)}")
            first = self.residual(0, state.df).observe(seen, F.sum(F.col("r") * F.col("r") * F.col("m")).alias("rr"))
            swept = table(first.withColumn("x", F.col("x") + self.weight(0, 0, omega) * F.col("d") * F.col("r")).drop("r"), "i", "state")
            norms.append(max(0.0, seen.get["rr"] or 0.0) ** 0.5)
            done = tolerance > 0 and norms[0] > 1e-15 and norms[-1] / norms[0] < tolerance
            if done or len(norms) > max_cycles:
                forget(state.df.sparkSession, *swept.names)
                return state.df.select("i", F.col("x").alias("v")), norms
            forget(state.df.sparkSession, *state.names)
            state = self.below(0, self.smooth(0, swept, range(1, pre), omega), pre, post, omega)
