"""The generated cube: a grid of N^3 points on the unit cube, six tetrahedra round each cell's diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The six tetrahedra of a cell by corner, corner bits being x, y, z from the lowest.
CELL_TETS = ((0, 1, 3, 7), (0, 5, 1, 7), (0, 4, 5, 7), (0, 6, 4, 7), (0, 2, 6, 7), (0, 3, 2, 7))


def grid(resolution: int) -> int:
    return max(2, resolution)


def cube_vertices(spark: SparkSession, resolution: int) -> DataFrame:
    n = grid(resolution)
    step = F.lit(1.0 / (n - 1))
    vid = F.col("id")
    x, y, z = vid % n, F.floor(vid / n) % n, F.floor(vid / (n * n))
    return spark.range(n**3).select(vid.alias("vid"), (x * step).alias("x"), (y * step).alias("y"), (z * step).alias("z"))


def cube_tets(spark: SparkSession, resolution: int) -> DataFrame:
    n = grid(resolution)
    m = n - 1
    cell = F.col("id")
    base = cell % m + F.floor(cell / m) % m * n + F.floor(cell / (m * m)) * (n * n)
    corner = [base + (k & 1) + (k >> 1 & 1) * n + (k >> 2) * n * n for k in range(8)]
    rows = F.array(*[F.struct((cell * 6 + t).alias("tid"), *[corner[k].alias(f"v{i}") for i, k in enumerate(tet)]) for t, tet in enumerate(CELL_TETS)])
    return spark.range(m**3).select(F.inline(rows)).select("tid", *[F.col(f"v{i}").cast("long").alias(f"v{i}") for i in range(4)])


def cube_mesh(spark: SparkSession, resolution: int) -> tuple[DataFrame, DataFrame]:
    return cube_vertices(spark, resolution), cube_tets(spark, resolution)
