"""Geodesic clusters and the coarse graphs that they span."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.storage import bucketed, forget, settle, settled

#: Rounds whose frontiers stand beside the labels before they are merged into them.
MERGE = 4


def nearest(labels: DataFrame) -> DataFrame:
    """One label a vertex: the least distance, ties to the smaller label."""
    best = labels.groupBy("vid").agg(F.min(F.struct("dist", "coarse_id")).alias("hit"))
    return best.select("vid", "hit.coarse_id", "hit.dist")


def relax(labels: DataFrame, edges: DataFrame, frontier: DataFrame, locked: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Multi-source shortest paths with labels: (vid, coarse_id, dist), by relaxing edges (src, dst, len) from
    the vertices that changed until none does; ties go to the smaller label. ``locked`` (vid) never change.

    Edges lie in buckets of their start and labels in buckets of their vertex, so that a round moves only the frontier's
    labels. What has changed since the labels were written stands beside them and is joined in every MERGE rounds."""
    spark = labels.sparkSession
    if locked is not None:
        edges = edges.join(locked.select(F.col("vid").alias("dst")), "dst", "left_anti")
    edges, by_start = bucketed(edges.select("src", "dst", "len"), "src", "edges")
    state, held = bucketed(labels.select("vid", "coarse_id", "dist"), "vid", "labels")
    front = frontier.select("vid", "coarse_id", "dist")
    news: list[str] = []  # frontiers that are not joined into the state
    done = 0
    while not front.isEmpty() and (rounds is None or done < rounds):
        moves = front.join(edges, front["vid"] == edges["src"]).select(F.col("dst").alias("vid"), F.struct((F.col("dist") + F.col("len")).alias("dist"), "coarse_id").alias("hit"))
        best = moves.groupBy("vid").agg(F.min("hit").alias("hit"))
        old = best.join(state.select("vid", F.struct("dist", "coarse_id").alias("old")), "vid", "left")
        if news:
            old = old.join(nearest(gathered(spark, news, state.schema)).select("vid", F.struct("dist", "coarse_id").alias("fresh")), "vid", "left").withColumn("old", F.coalesce("fresh", "old"))
        better = old.where(F.col("old").isNull() | (F.col("hit") < F.col("old"))).select("vid", "hit.coarse_id", "hit.dist")
        front, path = settled(better, "frontier")
        news.append(path)
        if len(news) == MERGE:
            state, held, news = merged(state, held, news, path)
        done += 1
    whole = settle(state if not news else merged(state, held, news)[0], "labels")
    forget(spark, *by_start, *held)
    return whole


def gathered(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The frontiers at ``paths``; of a vertex's labels the last one is the least."""
    return spark.read.schema(schema).parquet(*paths)


def merged(state: DataFrame, held: tuple[str, str], news: list[str], keep: str | None = None) -> tuple[DataFrame, tuple[str, str], list[str]]:
    """The labels with the frontiers found since, which are better where both have one; ``keep`` isn't deleted yet."""
    spark = state.sparkSession
    fresh = nearest(gathered(spark, news, state.schema)).select("vid", F.struct("coarse_id", "dist").alias("fresh"))
    both = state.select("vid", F.struct("coarse_id", "dist").alias("old")).join(fresh, "vid", "full").withColumn("now", F.coalesce("fresh", "old"))
    whole, names = bucketed(both.select("vid", "now.coarse_id", "now.dist"), "vid", "labels")
    forget(spark, *held, *[n for n in news if n != keep])
    return whole, names, [keep] if keep else []


def sources(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("fine_vid").alias("vid"), "coarse_id", F.lit(0.0).alias("dist"))


def cluster(samples: DataFrame, edges: DataFrame, warm: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Nearest sample of each vertex along edges, starting from the labels ``warm`` where given."""
    start = sources(samples)
    labels = start if warm is None else nearest(warm.unionByName(start))
    return relax(labels, edges, start, rounds=rounds)


def quotient(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst) coarse edges, both ways: fine edges (src, dst) whose ends belong to different clusters."""
    label = lambda end, name: clusters.select(F.col("vid").alias(end), F.col("coarse_id").alias(name))
    ends = edges.select("src", "dst").join(label("src", "cs"), "src").join(label("dst", "cd"), "dst").where("cs <> cd")
    one = ends.select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (vid)."""
    return edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi")


def without_inner(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges but for those with both ends in ``ids`` (vid)."""
    flag = lambda end: ids.select(F.col("vid").alias(end), F.lit(True).alias(f"in_{end}"))
    return edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").where("in_src is null or in_dst is null").select(*edges.columns)


def standard(samples: DataFrame, edges: DataFrame, warm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, coarse edges) over one graph."""
    clusters = cluster(samples, edges, warm)
    return clusters, settle(quotient(edges, clusters), "coarse")


def exterior_first(vertices: DataFrame, samples: DataFrame, marks: DataFrame, exterior: DataFrame, ext_edges: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, coarse edges, exterior coarse edges), the surface first.

    Exterior vertices are clustered along ``ext_edges`` only, from exterior samples; then interior ones along
    ``edges``, starting from the labels of the sampling (``marks``), with the exterior ones locked. An
    exterior vertex that the surface doesn't reach keeps label 0 without a distance and still spans coarse
    edges. Coarse edges are those of the surface and those of the volume without its exterior-exterior edges."""
    ids = exterior.select("vid")
    surface = relax(sources(samples.where("is_exterior")), ext_edges, sources(samples.where("is_exterior")))
    surface = ids.join(surface, "vid", "left").select("vid", F.coalesce("coarse_id", F.lit(0).cast("bigint")).alias("coarse_id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
    surface = settle(surface, "surface")
    ext_coarse = settle(quotient(ext_edges, surface), "ext-coarse")
    inner = sources(samples.where(~F.col("is_exterior")))
    start = nearest(marks.join(ids, "vid", "left_anti").unionByName(inner))
    front = inner.unionByName(surface.where(F.col("dist") < float("inf")))
    clusters = relax(start.unionByName(surface), edges, front, locked=ids)
    clusters = vertices.select("vid").join(clusters, "vid", "left").select("vid", F.coalesce("coarse_id", F.lit(0).cast("bigint")).alias("coarse_id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
    clusters = settle(clusters, "clusters")
    volume = quotient(without_inner(edges, ids), clusters)
    return clusters, settle(ext_coarse.unionByName(volume).distinct(), "coarse"), ext_coarse
