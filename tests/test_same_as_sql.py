"""Where rows depend on the last bit of a number, as the SQL has it."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import prolong


def test_edges_at_one_distance_are_told_apart_by_the_pow_of_the_sql(spark):
    rng = np.random.default_rng(3)
    points = pa.table({k: x for k, x in zip("xyz", rng.random((3, 40_000)) - 0.5, strict=True)} | {"i": np.arange(40_000)})
    want = dict(duckdb.sql("SELECT i, sqrt(pow(x, 2) + pow(y, 2) + pow(z, 2)) FROM points").fetchall())
    point = F.struct("x", "y", "z").alias("p")
    rows = spark.createDataFrame(points).select("i", point).select("i", prolong.length_by_pow("p.x", "p.y", "p.z").alias("c"), G.norm(F.col("p")).alias("jvm")).collect()
    assert {r.i: r.c for r in rows} == want
    assert any(r.c != r.jvm for r in rows)


def test_interpolation_takes_distances_to_edges_from_that_pow(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(prolong, "length_by_pow", lambda *c: asked.append(c) or F.lit(1.0))
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    samples = spark.createDataFrame([(0, 0, False)], "coarse_id long, fine_vid long, is_exterior boolean")
    clusters = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0)], "vid long, coarse_id long, dist double")
    none = lambda names: spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    p, _ = prolong.interpolation(v, samples, clusters, none(["src", "dst"]), none("abc"), none("abcd"))
    assert sorted(p.collect()) == [(0, 0, 1.0), (1, 0, 1.0)] and asked == [("off.x", "off.y", "off.z")]
