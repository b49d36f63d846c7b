"""Schemas of the relations. Ids are explicit columns, never row numbers."""

from pyspark.sql import types as T

TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def struct(ddl: str) -> T.StructType:
    """A struct type from "name type, ..."; needs no session, so data source workers can use it."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


VERTICES = struct("vid bigint, x double, y double, z double")
TETS = struct("tid bigint, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
EDGES = struct("src bigint, dst bigint, len double")
SAMPLES = struct("coarse_id bigint, fine_vid bigint, is_exterior boolean")
CLUSTERS = struct("vid bigint, coarse_id bigint, dist double")
MATRIX = struct("i bigint, j bigint, v double")
VECTOR = struct("i bigint, v double")
HISTORY = struct("problem string, cycle int, residual double, cycle_ms double")
STAGE_TIMING = struct("level int, stage string, ms double")
