"""Triangles and four-cliques of a graph, each once, corners ascending.

Edges are oriented from the corner of lower degree to that of higher degree before they meet, which
bounds a corner's out-degree by the square root of twice the edges whatever the hubs. What meets are lists of ends: a
wedge is never a row, and only triangles are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.storage import bucketed


def oriented(edges: DataFrame) -> DataFrame:
    """(u, v): each undirected edge of (src, dst) once, towards the higher (degree, id)."""
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    once = edges.where("src < dst")
    with_n = once.join(degree, "src").withColumnRenamed("n", "ns").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("nd")), "dst")
    up = F.col("ns") <= F.col("nd")
    return with_n.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"), F.when(up, F.col("nd")).otherwise(F.col("ns")).alias("nv"))


def held(edges: DataFrame) -> DataFrame:
    """(u, vs): the ends of each corner's oriented edges, ascending by (degree, id), written once, in buckets of the
    corner, since every join reads them."""
    ends = F.transform(F.array_sort(F.collect_set(F.struct("nv", "v"))), lambda e: e["v"])
    return bucketed(oriented(edges).groupBy("u").agg(ends.alias("vs")), "u", "oriented")[0]


def common(rows: DataFrame, up: DataFrame, key: str, ends: str) -> DataFrame:
    """``rows`` whose list ``ends`` has ends of the corner ``key``, and only those. The lists of ``up`` are hashed, not sorted,
    as they are the smaller side."""
    own = up.select(F.col("u").alias(key), F.col("vs").alias("_own")).hint("shuffle_hash")
    return rows.join(own, key).withColumn(ends, F.array_intersect(ends, "_own")).drop("_own").where(F.size(ends) > 0)


def closed(up: DataFrame) -> DataFrame:
    """(u, v, ws): each oriented edge that has triangles, with their third corners: the ends of u that come after v, met
    with those of v."""
    after = up.where(F.size("vs") > 1).select("u", "vs", F.posexplode("vs").alias("_at", "v"))
    later = after.where(F.col("_at") + 1 < F.size("vs")).select("u", "v", F.slice("vs", F.col("_at") + 2, F.size("vs")).alias("ws"))
    return common(later, up, "v", "ws")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, of the graph (src, dst), both directions given."""
    made = closed(held(edges)).select("u", "v", F.explode("ws").alias("w"))
    return made.select(F.array_sort(F.array("u", "v", "w")).alias("t")).select(*[F.col("t")[i].alias(n) for i, n in enumerate("abc")])


def four_cliques(edges: DataFrame) -> DataFrame:
    """(a, b, c, d), ascending: edges with two third corners that are joined themselves."""
    up = held(edges)
    grown = closed(up).where(F.size("ws") > 1).select("u", "v", F.explode("ws").alias("w"), F.col("ws").alias("xs"))
    made = common(grown, up, "w", "xs").select("u", "v", "w", F.explode("xs").alias("x"))
    return made.select(F.array_sort(F.array("u", "v", "w", "x")).alias("t")).select(*[F.col("t")[i].alias(n) for i, n in enumerate("abcd")])
