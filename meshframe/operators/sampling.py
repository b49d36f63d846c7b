"""Priority disk sampling: the first maximal set, in a given order, of vertices no two of which are joined by
a path of at most two edges shorter than a radius.

A vertex whose priority beats those of all undecided vertices in conflict with it is taken, those in conflict
with it are settled, and so on: the result is that of going through the vertices one by one. Graphs of up to
``LOCAL`` vertices and ``CONFLICTS`` times as many conflicts do just that on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.operators.exterior import ranked
from meshframe.storage import forget, settle, settled

#: Vertices, and conflicts a vertex, that the driver takes on at most; above, every round is distributed.
LOCAL, CONFLICTS = 20_000, 64


def reach(edges: DataFrame, radius: float, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, dist): the shortest path of one or two edges between two vertices, where it is under the
    radius, from those of ``starts`` (src) alone where given; edges are (src, dst, len) both ways."""
    short = edges.where(F.col("len") < radius)
    first = short if starts is None else short.join(starts.select("src"), "src", "left_semi")
    two = first.select("src", F.col("dst").alias("mid"), F.col("len").alias("d1")).join(short.select(F.col("src").alias("mid"), "dst", F.col("len").alias("d2")), "mid")
    paths = two.select("src", "dst", (F.col("d1") + F.col("d2")).alias("dist")).where((F.col("src") != F.col("dst")) & (F.col("dist") < radius))
    return first.select("src", "dst", F.col("len").alias("dist")).unionByName(paths).groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def pick_local(priority: DataFrame, near: DataFrame) -> DataFrame:
    """The chosen ids, by going through the order on the driver; for at most LOCAL vertices."""
    order = [r.vid for r in priority.orderBy("rank", "vid").select("vid").toLocalIterator()]
    lists = {r.src: r.ds for r in near.groupBy("src").agg(F.collect_list("dst").alias("ds")).toLocalIterator()}
    seen: set[int] = set()
    chosen = []
    for v in order:
        if v not in seen:
            chosen.append((v,))
            seen.add(v)
            seen.update(lists.get(v, ()))
    return priority.sparkSession.createDataFrame(chosen, "vid bigint")


def pick_rounds(priority: DataFrame, near: DataFrame) -> DataFrame:
    """The same by rounds over the whole cluster; each is written to the shared folder.

    A vertex is held back by the rivals before it in the order. In a round those without any are taken, those held back
    by a taken one are out, and the conflicts of all decided ones go, so the conflict graph shrinks. Where only one rival
    is left, a vertex is taken exactly if that rival is out: such chains are followed to their ends by pointer jumping,
    so a chain of any length takes a number of joins that grows with its logarithm."""
    spark = priority.sparkSession
    key = lambda end, name: priority.select(F.col("vid").alias(end), F.struct("rank", "vid").alias(name))
    held = near.join(key("src", "own"), "src").join(key("dst", "other"), "dst").where("other < own").select(F.col("src").alias("vid"), F.col("dst").alias("rival"))
    open_, before = settled(priority.select("vid"), "open")
    held, links = settled(held, "conflicts")
    chosen: list[DataFrame] = []
    while not open_.isEmpty():
        blocked = held.groupBy("vid").agg(F.count("*").alias("n"), F.min("rival").alias("rival"))
        free = open_.join(blocked, "vid", "left_anti").select("vid")
        ends, paths = chain_ends(blocked.where("n = 1").select("vid", "rival", F.lit(True).alias("odd")))
        followed = ends.join(free.select(F.col("vid").alias("rival")), "rival", "left_semi")
        won = settle(free.unionByName(followed.where("not odd").select("vid")), "won")
        lost = held.join(won.select(F.col("vid").alias("rival")), "rival", "left_semi").select("vid").unionByName(followed.where("odd").select("vid"))
        lost, out = settled(lost.distinct(), "lost")
        chosen.append(won)
        gone = won.unionByName(lost)
        left, after = settled(open_.join(gone, "vid", "left_anti"), "open")
        rest, more = settled(held.join(gone, "vid", "left_anti").join(lost.select(F.col("vid").alias("rival")), "rival", "left_anti").select("vid", "rival"), "conflicts")
        forget(spark, before, links, out, *paths)
        open_, before, held, links = left, after, rest, more
    if not chosen:
        return priority.select("vid")
    return reduce(DataFrame.unionByName, chosen)


def chain_ends(single: DataFrame) -> tuple[DataFrame, list[str]]:
    """(vid, rival, odd) with each pointer followed as far as pointers go, ``odd`` if the steps are; a round of jumps
    doubles the length that is covered. Also the files to delete once it is read. Rivals come earlier in an order, so there
    are no cycles."""
    spark = single.sparkSession
    now, path = settled(single, "pointers")
    while True:
        ahead = now.select(F.col("vid").alias("rival"), F.col("rival").alias("next"), F.col("odd").alias("more"))
        moved = now.join(ahead, "rival", "left").select("vid", F.coalesce("next", "rival").alias("rival"), F.when(F.col("next").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("more")).alias("odd"), F.col("next").isNotNull().alias("moved"))
        after, new = settled(moved, "pointers")
        forget(spark, path)
        now, path = after.drop("moved"), new
        if after.where("moved").isEmpty():
            return now, [path]


def numbered(chosen: DataFrame) -> DataFrame:
    """Samples with their place in the order, exterior ones first, as coarse_id."""
    order = [F.desc("is_exterior"), F.col("place"), F.col("vid")]
    made = ranked(chosen.withColumnRenamed("rank", "place"), order)
    return made.select(F.col("rank").cast("bigint").alias("coarse_id"), F.col("vid").alias("fine_vid"), "is_exterior")


def disk_sample(priority: DataFrame, edges: DataFrame, radius: float, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """(samples, clusters) for ``priority`` (vid, rank, is_exterior) and edges (src, dst, len) both ways.

    Samples are (coarse_id, fine_vid, is_exterior), exterior ones first, then by rank. Clusters (vid,
    coarse_id, dist) hold, for the vertices that a sample's marking reached, the nearest one."""
    near = settle(reach(edges, radius), "reach")
    small = priority.limit(local + 1).count() <= local and near.limit(local * CONFLICTS + 1).count() <= local * CONFLICTS
    chosen = pick_local(priority, near) if small else pick_rounds(priority, near)
    samples = settle(numbered(priority.join(chosen, "vid", "left_semi")), "samples")
    marks = near.join(samples.select(F.col("fine_vid").alias("src"), "coarse_id"), "src").select(F.col("dst").alias("vid"), F.struct("dist", "coarse_id").alias("hit"))
    own_marks = samples.select(F.col("fine_vid").alias("vid"), F.struct(F.lit(0.0).alias("dist"), "coarse_id").alias("hit"))
    clusters = marks.unionByName(own_marks).groupBy("vid").agg(F.min("hit").alias("hit")).select("vid", "hit.coarse_id", "hit.dist")
    return samples, settle(clusters, "marks")
