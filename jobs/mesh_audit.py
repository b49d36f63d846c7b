"""Audit of tetrahedral meshes before a solver takes them: one mesh for each month of orders.

A solver needs to know of a mesh which tetrahedra are flat or slivers, where its boundary runs, and whether a face has
more than two tetrahedra. The orders of a month make up one mesh (an order with four or more parts is a tetrahedron);
the job measures each of its tetrahedra and writes them partitioned by month. A run of all months replaces everything,
a run of some replaces these alone (dynamic partition overwrite), and a rerun leaves the same rows.

    python -m jobs.mesh_audit --tables /data/sf0.1 --output /data/audit --config jobs/mesh_audit.json

Settings: ``months``, the months to do ("1995-03", all if null); ``flat``, the volume under which a tetrahedron counts
as flat; ``files``, the files a month is split into. Orders without a date belong to month "none"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, settings
from meshframe.functions import geometry as G
from meshframe.operators import topology
from meshframe.sources import orders

DEFAULTS = {"months": None, "flat": 1e-12, "files": 1}
#: The quality of a regular tetrahedron is 1: 6 sqrt(2) times its volume over the cube of its longest edge.
REGULAR = 6 * 2**0.5


def monthly_tets(spark: SparkSession, tables: str, months: list[str] | None) -> DataFrame:
    """The tetrahedra of the chosen months; the choice reaches the scan of orders and, by the join, the lines."""
    dated = spark.read.parquet(f"{tables}/orders.parquet").select(F.col("o_orderkey").alias("tid"), F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("none")).alias("month"))
    if months is not None:
        dated = dated.where(F.col("month").isin(months))
    return orders.order_tets(spark, tables).join(dated, "tid")


def measured(tets: DataFrame, vertices: DataFrame, flat: float) -> DataFrame:
    """Volume, edges and quality of each tetrahedron. Corners are met one by one, by equi-joins."""
    p = [F.col(f"p{i}") for i in range(4)]
    edges = [G.distance(p[i], p[j]) for i, j in topology.TET_EDGES]
    sized = topology.tet_points(tets, vertices).select("month", "tid", *[f"v{i}" for i in range(4)], G.volume(*p).alias("volume"), F.least(*edges).alias("shortest"), F.greatest(*edges).alias("longest"))
    quality = F.coalesce(F.try_divide(REGULAR * F.col("volume"), F.pow("longest", F.lit(3))), F.lit(0.0))
    return sized.withColumns({"quality": quality, "is_flat": F.col("volume") < flat})


def face_counts(tets: DataFrame) -> DataFrame:
    """(month, tid, n_boundary, n_crowded): faces of a tetrahedron that no other of its month has, and those that more
    than one other has. Faces are counted by month and corners, with partial counts before the shuffle; a tetrahedron's
    own faces meet their counts by the same key."""
    faces = topology.tet_faces(tets.withColumn("tid", F.struct("month", "tid"))).select(F.col("tid.month").alias("month"), F.col("tid.tid").alias("tid"), "a", "b", "c")
    counts = faces.groupBy("month", "a", "b", "c").agg(F.count("*").alias("n"))
    return faces.join(counts, ["month", "a", "b", "c"]).groupBy("month", "tid").agg(F.count_if(F.col("n") == 1).alias("n_boundary"), F.count_if(F.col("n") > 2).alias("n_crowded"))


def run(spark: SparkSession, tables: str, output: str, months: list[str] | None = None, flat: float = DEFAULTS["flat"], files: int = DEFAULTS["files"]) -> DataFrame:
    """Audit the months and return all that stands in ``output`` then, other months included."""
    tets = monthly_tets(spark, tables, months)
    audit = measured(tets, orders.order_vertices(spark, tables), flat).join(face_counts(tets), ["month", "tid"])
    LOG.info("mesh_audit reads orders, lineitem and part of %s, months %s", tables, "all" if months is None else ", ".join(months))
    spread = audit.withColumn("_file", F.pmod(F.xxhash64("tid"), F.lit(files)))
    with settings(spark, spark__sql__sources__partitionOverwriteMode="static" if months is None else "dynamic"):
        spread.repartition("month", "_file").drop("_file").write.mode("overwrite").partitionBy("month").parquet(output)
    written = spark.read.schema(audit.schema).parquet(output)
    done = written if months is None else written.where(F.col("month").isin(months))
    told = done.agg(F.count_distinct("month").alias("months"), F.count("*").alias("tets"), F.count_if("is_flat").alias("flat"), F.sum("n_boundary").alias("boundary"), F.min("quality").alias("worst")).first()
    LOG.info("mesh_audit wrote %s tetrahedra of %s months to %s: %s flat, %s boundary faces, worst quality %s", told.tets, told.months, output, told.flat, told.boundary, told.worst)
    return written


if __name__ == "__main__":
    command("mesh_audit", __doc__.split("\n")[0], {"tables": "folder of the tables", "output": "folder of the audit"}, run, DEFAULTS)
