"""Series and totals for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def residual_curve(history: DataFrame) -> DataFrame:
    """(problem, cycle, seconds, relative): residuals against the first, 1e-16 in place of values up to 0,
    over the running time. Windows run inside one problem's cycles, which a solve bounds."""
    order = Window.partitionBy("problem").orderBy("cycle")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relative = F.try_divide(F.col("residual"), F.first("residual").over(order))
    return history.select("problem", "cycle", (F.sum("cycle_ms").over(running) / 1000).alias("seconds"), F.when(relative > 0, relative).otherwise(1e-16).alias("relative"))


def stage_totals(timing: DataFrame) -> DataFrame:
    return timing.groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("levels"))


def timing_drift(timing: DataFrame, total_ms: float, allowed_ms: float = 5.0) -> DataFrame:
    """One row: how far the stages' sum is from the total, and whether that is over what is allowed."""
    drift = F.abs(F.coalesce(F.sum("ms"), F.lit(0.0)) - total_ms)
    return timing.agg(drift.alias("drift_ms"), (drift > allowed_ms).alias("over"))


def phase_bars(results: DataFrame) -> DataFrame:
    """(problem, phase, seconds): hierarchy, setup and solve times for a stacked bar."""
    rows = F.array(*[F.struct(F.lit(k).alias("phase"), (F.col(c) / 1000).alias("seconds")) for k, c in (("hierarchy", "hierarchy_build_ms"), ("setup", "setup_time_ms"), ("solve", "total_time_ms"))])
    return results.select("problem", F.inline(rows))
