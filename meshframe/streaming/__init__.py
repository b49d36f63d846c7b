"""Mesh tables as they arrive: running aggregates over a stream of tetrahedra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe import schema
from meshframe.operators.topology import tet_faces


def read_tets(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of tet rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema.TETS).parquet(folder)


def face_counts(tets: DataFrame) -> DataFrame:
    """(a, b, c, n): how many tets have each face so far; the boundary is where n is 1. Complete or update
    mode; the state has a row for each face."""
    return tet_faces(tets).groupBy("a", "b", "c").agg(F.count("*").alias("n"))
