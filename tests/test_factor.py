import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import factor


def grid(spark, m, shift=0.1):
    """The seven-point matrix of an m^3 grid plus a shift, and its rows with coordinates."""
    at = lambda k: (F.floor(F.col("i") / m**k) % m).cast("int")
    places = spark.range(m**3).select(F.col("id").alias("i")).select("i", *[at(k).cast("double").alias(a) for k, a in enumerate("xyz")])
    off = [places.where(F.col(a) < m - 1).select("i", (F.col("i") + m**k).alias("j")) for k, a in enumerate("xyz")]
    one = off[0].unionByName(off[1]).unionByName(off[2])
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"))).withColumn("v", F.lit(-1.0))
    return both.unionByName(places.select("i", F.col("i").alias("j"), F.lit(6.0 + shift).alias("v"))), places


def vector(df, n):
    out = np.full(n, np.nan)
    for r in df.collect():
        out[r.i] = r.v
    return out


def dense(a, n):
    out = np.zeros((n, n))
    for r in a.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_against_dense(spark, depth):
    a, places = grid(spark, 6)
    b = np.random.default_rng(depth).standard_normal(216)
    f = factor.factorise(a, places, depth)
    rows = {r.i: r.node for r in f.nodes.collect()}
    assert len(rows) == 216 and len(f.fronts) == depth + 1
    got = vector(factor.solve(f, spark.createDataFrame(list(enumerate(b.tolist())), "i long, v double")), 216)
    want = dense(a, 216)
    if depth:  # separators: entries join a node with itself or one above
        above = lambda s, t: any(t >> k == s for k in range(depth + 1))
        assert all(above(rows[i], rows[j]) or above(rows[j], rows[i]) for i, j in zip(*np.nonzero(want), strict=True))
        assert max(rows.values()) >= 1 << depth
    assert np.abs((want * got).sum(axis=1) - b).max() < 1e-10


def test_indefinite_repeated_and_missing_entries(spark):
    places = spark.createDataFrame([(k, float(k), 0.0, None) for k in range(9)], "i long, x double, y double, z double")
    entries = [(k, k, -3.0 if k % 2 else 2.0) for k in range(9)] + [(k, k, 0.5) for k in range(9)] + [(k, k + 1, 1.0) for k in range(8)] + [(k + 1, k, 1.0) for k in range(8)]
    a = spark.createDataFrame(entries, "i long, j long, v double")
    b = spark.createDataFrame([(4, 1.0), (7, -2.0)], "i long, v double")
    want = np.zeros(9)
    want[[4, 7]] = 1.0, -2.0
    got = vector(factor.solve(factor.factorise(a, places, 2), b), 9)
    assert np.abs((dense(a, 9) * got).sum(axis=1) - want).max() < 1e-12


def test_zero_pivot_raises(spark):
    a, places = grid(spark, 3, shift=-6.0)
    with pytest.raises(Exception, match="pivot is zero"):
        factor.factorise(a.where("i <> j"), places, 1).fronts[-1].count()
    with pytest.raises(Exception, match="pivot is zero"):
        factor.factorise(a.limit(0), places, 0)


def test_twenty_thousand_rows(spark):
    """27^3 = 19,683 rows: the solution is known, so the error is that of the factors."""
    m = 27
    a, places = grid(spark, m)
    x = places.select("i", (F.pmod(F.xxhash64("i"), F.lit(1000)) / 1000).alias("v"))
    b = a.join(x.withColumnRenamed("i", "j").withColumnRenamed("v", "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    solved = factor.solve(factor.factorise(a, places), b)
    off = solved.join(x.withColumnRenamed("v", "want"), "i").agg(F.max(F.abs(F.col("v") - F.col("want"))).alias("off"), F.count("*").alias("n")).first()
    assert off.n == m**3 and off.off < 1e-10


def test_no_relation_of_the_rows_is_broadcast(spark, monkeypatch):
    """Only cuts, one row a node, may go through the driver."""
    seen = []
    settle = factor.settle

    def watched(df, label="step"):
        made = settle(df, label)
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return made

    monkeypatch.setattr(factor, "settle", watched)
    a, places = grid(spark, 6)
    b = a.groupBy("i").agg(F.sum("v").alias("v"))
    assert factor.solve(factor.factorise(a, places, 2), b).count() == 216
    assert {x for x, plan in seen if "BroadcastHashJoin" in plan} <= {"sides"} and len(seen) > 15
