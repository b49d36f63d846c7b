"""Interpolation from coarse to fine vertices, by seven cases."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from meshframe.functions import geometry as G
from meshframe.storage import settle

TINY = 1e-12
#: Points and list rows of one centre that meet in one block.
BLOCK = 1_024


@F.arrow_udf(returnType=DoubleType())
def length_by_pow(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
    """The root of the sum of the coordinates' squares by the C library's pow, which isn't always the rounded square. It
    decides between edges at one distance as C and SQL do; the JVM's pow(x, 2) is x * x."""
    rows = zip(x.to_pylist(), y.to_pylist(), z.to_pylist(), strict=True)
    return pa.array([None if None in r else math.sqrt(math.pow(r[0], 2.0) + math.pow(r[1], 2.0) + math.pow(r[2], 2.0)) for r in rows], pa.float64())


def placed(df: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with positions q_<key> from points (id, q)."""
    for k in keys:
        df = df.join(points.select(F.col("id").alias(k), F.col("q").alias(f"q_{k}")), k)
    return df


def best(df: DataFrame, order: list[str], keep: list) -> DataFrame:
    """The first row of each fine vertex in an order, by a minimum over structs (no sort)."""
    return df.groupBy("f").agg(F.min(F.struct(*order, F.struct(*keep).alias("kept"))).alias("top")).select("f", "top.kept.*")


def rotated(cliques: DataFrame, corners: list[str]) -> DataFrame:
    """(c, order..., r1, ...): each clique for each of its corners c, with the others in cyclic order."""
    n = len(corners)
    rows = F.array(*[F.struct(*[F.col(corners[(s + i) % n]).alias(f"r{i}") for i in range(n)], *[F.col(k).alias(f"o_{k}") for k in corners]) for s in range(n)])
    return cliques.select(F.inline(rows)).withColumnRenamed("r0", "c")


def met(points: DataFrame, lists: DataFrame) -> DataFrame:
    """Fine points (f, c, ...) with the rows of ``lists`` (c, ...) at their centre: a join on c whose heavy centres are
    cut into blocks of up to about BLOCK points and BLOCK rows. The counts of both sides say into how many; each row then
    goes to the blocks of one row of that grid, each point to those of one column, so that every pair meets once."""
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    count = lambda df, n: df.groupBy("c").agg(F.count("*").alias(n))
    grid = settle(count(points, "np").join(count(lists, "nl"), "c").select("c", parts("np").alias("bp"), parts("nl").alias("bl")), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = points.join(grid, "c").withColumn("_p", F.pmod(F.xxhash64("f"), F.col("bp")).cast("int")).withColumn("_l", each("bl"))
    own = [F.col(k) for k in lists.columns if k != "c"]
    right = lists.join(grid, "c").withColumn("_l", F.pmod(F.xxhash64(*own), F.col("bl")).cast("int")).withColumn("_p", each("bp"))
    return left.drop("bp", "bl").join(right.drop("bp", "bl"), ["c", "_p", "_l"]).drop("_p", "_l")


def tet_candidates(points: DataFrame, tets: DataFrame, coarse: DataFrame) -> DataFrame:
    """For fine points (f, c, p) the cliques at their centre that contain them: metric, corners, weights."""
    corners = ["c", "r1", "r2", "r3"]
    frames = G.tet_frames(placed(rotated(tets, list("abcd")), coarse, corners), [f"q_{k}" for k in corners], 1e-4)
    near = met(points, settle(frames.drop(*[f"q_{k}" for k in corners]), "frames4")).where(G.in_frame_box(F.col("p")))
    w, metric = G.tet_coordinates(F.col("p"))
    return near.select("f", "c", "r1", "r2", "r3", *[f"o_{k}" for k in "abcd"], *[x.alias(f"w{i}") for i, x in enumerate(w)], metric.alias("metric")).where(F.col("metric") > -1e-5)


def interpolation(vertices: DataFrame, samples: DataFrame, clusters: DataFrame, coarse_edges: DataFrame, triangles: DataFrame, tets: DataFrame, corrected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(P, cases): weights (i fine, j coarse, v), and (f, kind) with the case that each fine vertex took.

    0 a sample; 1 its centre has no neighbour; 2 it has one: projection on that edge; 3 the containing clique
    in which the vertex lies nearest a face; 4 the triangle nearest by its normal; 5 the nearest edge of the
    triangles, by the corner opposite, then projection on the edge from the centre to that corner (``corrected``
    leaves out the centre itself as that corner); 6 inverse distances to the centre and its three nearest
    neighbours. Weights up to 1e-12 are dropped in cases 3, 4 and 6; ties go to the first clique."""
    at = G.point(F.col("x"), F.col("y"), F.col("z"))
    coarse = settle(samples.join(vertices.withColumnRenamed("vid", "fine_vid"), "fine_vid").select(F.col("coarse_id").alias("id"), at.alias("q")), "coarse-points")
    degree = coarse_edges.groupBy(F.col("src").alias("c")).agg(F.count("*").alias("degree"), F.min("dst").alias("only"))
    own = samples.select(F.col("fine_vid").alias("f"), F.col("coarse_id").alias("own"))
    fine = vertices.select(F.col("vid").alias("f"), at.alias("p")).join(clusters.select(F.col("vid").alias("f"), F.col("coarse_id").alias("c")), "f").join(own, "f", "left").join(degree, "c", "left")
    fine = settle(fine, "fine")
    weight = lambda df, kind, *pairs: df.select("f", F.lit(kind).alias("kind"), F.inline(F.array(*[F.struct(j.alias("j"), v.alias("v")) for j, v in pairs])))
    one = F.lit(1.0)
    out = [weight(fine.where("own is not null"), 0, (F.col("own"), one)), weight(fine.where("own is null and degree is null"), 1, (F.col("c"), one))]

    def on_edge(df: DataFrame, kind: int) -> DataFrame:
        w = G.edge_weight(F.col("p"), F.col("q_c"), F.col("q_to"))
        return weight(placed(df, coarse, ["c", "to"]), kind, (F.col("c"), 1 - w), (F.col("to"), w))

    out.append(on_edge(fine.where("own is null and degree = 1").withColumn("to", F.col("only")), 2))
    rest = fine.where("own is null and degree > 1").select("f", "c", "p")
    found3 = settle(best(tet_candidates(rest, tets, coarse), ["metric", "o_a", "o_b", "o_c", "o_d"], ["c", "r1", "r2", "r3", "w0", "w1", "w2", "w3"]), "case3")
    out.append(weight(found3, 3, *zip([F.col(k) for k in ("c", "r1", "r2", "r3")], [F.col(f"w{i}") for i in range(4)], strict=True)).where(F.col("v") > TINY))
    rest = settle(rest.join(found3.select("f"), "f", "left_anti"), "rest4")
    frames = settle(G.triangle_frames(placed(rotated(triangles, list("abc")), coarse, ["c", "r1", "r2"]), ["q_c", "q_r1", "q_r2"]), "frames3")
    height, shares = G.triangle_projection(F.col("p"))
    kept = ["f", "c", "p", "r1", "r2", "o_a", "o_b", "o_c", "q_c", "q_r1", "q_r2"]
    tried = settle(met(rest, frames).select(*kept, height.alias("height"), *[x.alias(f"w{i}") for i, x in enumerate(shares)]), "triangles")
    found4 = settle(best(tried.where("height is not null"), ["height", "o_a", "o_b", "o_c"], ["c", "r1", "r2", "w0", "w1", "w2"]), "case4")
    out.append(weight(found4, 4, *zip([F.col(k) for k in ("c", "r1", "r2")], [F.col(f"w{i}") for i in range(3)], strict=True)).where(F.col("v") > TINY))
    rest = rest.join(found4.select("f"), "f", "left_anti")
    outside = tried.where("height is null").join(found4.select("f"), "f", "left_anti")
    p, q = F.col("p"), {k: F.col(f"q_{k}") for k in ("c", "r1", "r2")}
    sides = F.array(*[F.struct(F.col(k).alias("to"), G.edge_offset(p, q[a], q[b]).alias("off")) for k, a, b in (("r2", "c", "r1"), ("c", "r1", "r2"), ("r1", "r2", "c"))])
    recorded = outside.select("f", "c", "p", F.struct("o_a", "o_b", "o_c").alias("turn"), F.inline(sides))
    last = recorded.groupBy("f", "c", "p", "to").agg(F.max_by("off", "turn").alias("off"))  # later triangles overwrite
    last = last.withColumn("away", length_by_pow("off.x", "off.y", "off.z"))
    if corrected:
        last = last.where("to <> c")
    found5 = settle(best(last, ["away", "to"], ["c", "p", "to"]), "case5")
    out.append(on_edge(found5, 5))
    rest = rest.join(found5.select("f"), "f", "left_anti")
    near = placed(met(rest, coarse_edges.select(F.col("src").alias("c"), F.col("dst").alias("to"))), coarse, ["to"]).withColumn("d", G.distance(F.col("p"), F.col("q_to")))
    third = near.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("d", "to"))).where("r <= 3").select("f", "to", "d", "r")
    centre = placed(rest, coarse, ["c"]).select("f", F.col("c").alias("to"), G.distance(F.col("p"), F.col("q_c")).alias("d"), F.lit(0).alias("r"))
    out.append(inverse_distance(centre.unionByName(third)).select("f", F.lit(6).alias("kind"), F.col("to").alias("j"), "v").where(F.col("v") > TINY))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = settle(rows, "weights")
    return rows.groupBy(F.col("f").alias("i"), "j").agg(F.sum("v").alias("v")), rows.select("f", "kind").distinct()


def inverse_distance(df: DataFrame) -> DataFrame:
    """Rows (f, to, d, r) with ``v``: 1/d over its sum for each f, or 1 on the first hit (d < 1e-12)."""
    each = Window.partitionBy("f")
    hit = F.min(F.when(F.col("d") < TINY, F.col("r"))).over(each)
    inverse = F.try_divide(F.lit(1.0), F.col("d"))
    share = inverse / F.sum(F.when(F.col("d") >= TINY, inverse)).over(each)
    return df.withColumn("v", F.when(hit.isNotNull(), F.when(hit == F.col("r"), 1.0).otherwise(0.0)).otherwise(share))


def case_histogram(cases: DataFrame) -> DataFrame:
    counts = cases.groupBy("kind").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))
