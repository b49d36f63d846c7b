"""The order complex: a tetrahedral complex read off order tables. A part is a vertex; an order with four or
more distinct parts is a tetrahedron on its four smallest part keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def order_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    return part.select(
        key.alias("vid"), ((key * 7919 % 1009).cast("double") / 1009).alias("x"), ((key * 104729 % 2003).cast("double") / 2003).alias("y"), (F.col("p_size").cast("double") / 50).alias("z")
    )


def order_tets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle by order: the distinct parts of an order are gathered as a set, which is small."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    keys = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p")).where(F.size("p") >= 4)
    return keys.select(F.col("l_orderkey").alias("tid"), *[F.col("p")[i].alias(f"v{i}") for i in range(4)])


def order_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return order_vertices(spark, sf_dir), order_tets(spark, sf_dir)
