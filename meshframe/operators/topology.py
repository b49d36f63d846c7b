"""Faces, boundaries, adjacency and surfaces of tetrahedral complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import nearest
from meshframe.storage import small_partitions

# The faces of a tetrahedron with outward winding, and its edges, by corner.
FACES = ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))
TET_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def located(df: DataFrame, vertices: DataFrame, ids: list[str], names: list[str] | None = None) -> DataFrame:
    """``df`` with the positions of the vertices in columns ``ids`` as structs; rows without one go.
    Catalyst broadcasts the vertices while they are below the session's threshold."""
    at = vertices.select("vid", G.point(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    for k, name in zip(ids, names or [f"p_{k}" for k in ids], strict=True):
        df = df.join(at.withColumnsRenamed({"vid": "_vid", "p": name}), F.col(k) == F.col("_vid")).drop("_vid")
    return df


def check_mesh(vertices: DataFrame, tets: DataFrame) -> None:
    """Raise if a tet names a vertex that isn't there or one twice, or if ids repeat. Inner joins would drop the first
    kind of rows in silence."""
    corners = tets.select("tid", F.explode(F.array(*[f"v{i}" for i in range(4)])).alias("vid"))
    strange = corners.join(vertices.select("vid"), "vid", "left_anti")
    twice = tets.where(F.size(F.array_distinct(F.array(*[f"v{i}" for i in range(4)]))) < 4)
    repeated = vertices.groupBy("vid").agg(F.count("*").alias("n")).where("n > 1")
    for rows, what in ((strange, "vertices that are missing"), (twice, "a vertex twice"), (repeated, "ids that repeat")):
        if found := first_rows(rows):
            raise ValueError(f"the mesh has {what}: {', '.join(str(r.asDict()) for r in found)}")


def first_rows(rows: DataFrame, n: int = 5) -> list:
    """The first rows of a diagnosis, in their order; all others only count."""
    return rows.orderBy(*rows.columns).limit(n).collect()


def tet_points(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """``tets`` with corner positions p0..p3."""
    return located(tets, vertices, [f"v{i}" for i in range(4)], [f"p{i}" for i in range(4)])


def canonical(a: str, b: str, c: str) -> tuple:
    """Three columns in ascending order."""
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return low.alias("a"), (F.col(a) + F.col(b) + F.col(c) - low - high).alias("b"), high.alias("c")


def tet_faces(tets: DataFrame) -> DataFrame:
    """(tid, f0, f1, f2, a, b, c): the four faces of each tet, wound outwards and in canonical order."""
    rows = F.array(*[F.struct(*[F.col(f"v{k}").alias(f"f{i}") for i, k in enumerate(face)]) for face in FACES])
    faces = tets.select("tid", F.inline(rows))
    return faces.select("*", *canonical("f0", "f1", "f2"))


def boundary_faces(tets: DataFrame) -> DataFrame:
    """Faces that one tet alone has, with their winding; one shuffle, combined on the map side."""
    own = F.first(F.struct("tid", "f0", "f1", "f2")).alias("own")
    return tet_faces(tets).groupBy("a", "b", "c").agg(F.count("*").alias("n"), own).where("n = 1").select("own.*", "a", "b", "c")


def boundary_vertices(tets: DataFrame) -> DataFrame:
    return boundary_faces(tets).select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()


def undirected_edges(tets: DataFrame) -> DataFrame:
    """(a, b), a < b, each edge of the complex once."""
    rows = F.array(*[F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i, j in TET_EDGES])
    small_partitions(tets.sparkSession)
    return tets.select(F.inline(rows)).where("a <> b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected (a, b) as (src, dst) in both directions."""
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


def graph_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The edges of two graphs, each once."""
    return left.unionByName(right).distinct()


def graph_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The edges of the first graph that the second lacks."""
    return left.join(right, left.columns, "left_anti")


def adjacency(tets: DataFrame) -> DataFrame:
    return both_ways(undirected_edges(tets))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(vid, nbrs): ascending distinct neighbours."""
    return edges.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def with_length(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return located(edges, vertices, ["src", "dst"]).select("src", "dst", G.distance(F.col("p_src"), F.col("p_dst")).alias("len"))


def vertex_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))


def average_length(edges: DataFrame) -> DataFrame:
    """One row: the mean length of the edges with length, each taken once; 0 if there are none."""
    return edges.where((F.col("src") < F.col("dst")) & (F.col("len") > 0)).agg(F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"), F.count("*").alias("n_edges"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[f(a).alias(f"{n}_{a}") for a in G.AXES for n, f in (("min", F.min), ("max", F.max))])


def complex_surface(boundary: DataFrame, triangles: DataFrame) -> DataFrame:
    """(f0, f1, f2): boundary faces and clique triangles, once per corner set; a boundary face's winding wins."""
    small_partitions(boundary.sparkSession)
    both = boundary.select(F.lit(0).alias("source"), "f0", "f1", "f2").unionByName(triangles.select(F.lit(1).alias("source"), F.col("a").alias("f0"), F.col("b").alias("f1"), F.col("c").alias("f2")))
    marked = both.select("*", *canonical("f0", "f1", "f2"))
    return marked.groupBy("a", "b", "c").agg(F.min(F.struct("source", "f0", "f1", "f2")).alias("own")).select("own.f0", "own.f1", "own.f2")


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(vid, coarse_id, dist): nearest centre of every point, ties to the smaller id."""
    return nearest.nearest_centres(points, centres).select("vid", "coarse_id", "dist")


def remapped_surface(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """(f0, f1, f2): faces with corners replaced by their coarse vertices, once per corner set, without
    those that lost a corner or collapsed. ``mapping`` is (vid, coarse_id)."""
    out = faces.select("f0", "f1", "f2")
    for k in ("f0", "f1", "f2"):
        out = out.join(mapping.select(F.col("vid").alias("_v"), F.col("coarse_id").alias(f"{k}_new")), F.col(k) == F.col("_v")).drop("_v", k).withColumnRenamed(f"{k}_new", k)
    whole = out.where("f0 <> f1 and f1 <> f2 and f0 <> f2").select("f0", "f1", "f2", *canonical("f0", "f1", "f2"))
    return whole.groupBy("a", "b", "c").agg(F.min(F.struct("f0", "f1", "f2")).alias("own")).select("own.*")


def surface_depth(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vid, depth): 0 on the surface, 1 inside."""
    on = faces.select(F.explode(F.array("f0", "f1", "f2")).alias("vid")).distinct().withColumn("on", F.lit(True))
    return vertices.select("vid").join(on, "vid", "left").select("vid", F.when(F.col("on"), 0).otherwise(1).alias("depth"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(vid, first, degree): where each vertex's neighbours would start in one packed list. The running sum
    goes by blocks of ids, so no task sees all vertices."""
    degree = vertex_degree(edges).withColumn("block", F.floor(F.col("vid") / 65536))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = degree.groupBy("block").agg(F.sum("degree").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("vid").rowsBetween(Window.unboundedPreceding, -1)
    return degree.withColumn("own", F.coalesce(F.sum("degree").over(inner), F.lit(0))).join(blocks, "block").select("vid", (F.col("base") + F.col("own")).alias("first"), "degree")
