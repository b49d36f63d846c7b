"""The mesh queries by name: each takes (spark, sf_dir). Those named ``cube_`` run on generated cubes, the
others on the order complex of the tables at ``sf_dir`` unless said otherwise. Floats are rounded to six
digits, and ``+ 0.0`` turns a negative zero into zero."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import cliques, coarsen, exterior, pde, prolong, report, sampling, sparse, topology
from meshframe.plans import hierarchy, multigrid
from meshframe.sources import cube, orders, ply
from meshframe.storage import bucketed, current, settle, shared_folder

CUBE_N = 10
#: Tasks over which the pairs of one group of parts and tets are spread.
SALTS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def order_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, t = orders.order_mesh(spark, sf_dir)
    return v, t, topology.adjacency(t)


def whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(topology.adjacency(orders.order_tets(spark, sf_dir)), "edges")


def seeds(spark: SparkSession, sf_dir: str, step: int = 40) -> DataFrame:
    """Every ``step``-th part as a sample, labelled by its place."""
    part = orders.order_vertices(spark, sf_dir).where(F.col("vid") % step == 0)
    return part.select((F.col("vid") / step).cast("bigint").alias("coarse_id"), F.col("vid").alias("fine_vid"), (F.col("vid") % (2 * step) == 0).alias("is_exterior"))


def labels(spark: SparkSession, sf_dir: str, step: int = 40) -> DataFrame:
    """A clustering given by arithmetic: a part belongs to the group of its key."""
    return orders.order_vertices(spark, sf_dir).select("vid", F.floor(F.col("vid") / step).alias("coarse_id"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interpolation by arithmetic: part to group, weight 1."""
    return labels(spark, sf_dir).select(F.col("vid").alias("i"), F.col("coarse_id").alias("j"), F.lit(1.0).alias("v"))


def ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of the parts' keys modulo 17."""
    return orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("i"), (F.col("vid") % 17).cast("double").alias("v"))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph Laplacian of the order complex, with 1 added on the diagonal."""
    edges = topology.adjacency(orders.order_tets(spark, sf_dir))
    off = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("v"))
    return off.unionByName(topology.vertex_degree(edges).select(F.col("vid").alias("i"), F.col("vid").alias("j"), (F.col("degree") + 1.0).alias("v")))


@query
def boundary_faces(spark, sf_dir):
    return topology.boundary_faces(orders.order_tets(spark, sf_dir)).select("tid", "a", "b", "c")


@query
def boundary_vertices(spark, sf_dir):
    return topology.boundary_vertices(orders.order_tets(spark, sf_dir))


@query
def oriented_boundary(spark, sf_dir):
    return topology.boundary_faces(orders.order_tets(spark, sf_dir)).select("f0", "f1", "f2")


@query
def cube_vertices(spark, sf_dir):
    return rounded(cube.cube_vertices(spark, CUBE_N), "x", "y", "z")


@query
def cube_tets(spark, sf_dir):
    return cube.cube_tets(spark, CUBE_N)


@query
def edges_distinct(spark, sf_dir):
    return topology.undirected_edges(orders.order_tets(spark, sf_dir))


@query
def vertex_degree(spark, sf_dir):
    return topology.vertex_degree(topology.adjacency(orders.order_tets(spark, sf_dir)))


@query
def max_degree(spark, sf_dir):
    return vertex_degree(spark, sf_dir).agg(F.max("degree").alias("most"), F.count("*").alias("n"))


@query
def neighbour_offsets(spark, sf_dir):
    return topology.csr_offsets(topology.adjacency(orders.order_tets(spark, sf_dir)))


@query
def avg_edge_length(spark, sf_dir):
    v, _, edges = order_edges(spark, sf_dir)
    return rounded(topology.average_length(topology.with_length(edges, v)), "avg_len")


@query
def bounding_box(spark, sf_dir):
    box = topology.bounding_box(orders.order_vertices(spark, sf_dir))
    return rounded(box, *box.columns)


@query
def tet_volume(spark, sf_dir):
    v, t = orders.order_mesh(spark, sf_dir)
    return topology.tet_points(t, v).select("tid", r6(G.volume(*[F.col(f"p{i}") for i in range(4)])).alias("volume"))


@query
def solid_angle_sum(spark, sf_dir):
    return rounded(exterior.solid_angle_sums(*orders.order_mesh(spark, sf_dir)), "omega")


@query
def exterior_vertices(spark, sf_dir):
    return exterior.exterior_vertices(*cube.cube_mesh(spark, CUBE_N)).select("vid", r6("omega").alias("omega"))


@query
def dihedral_sum(spark, sf_dir):
    return rounded(exterior.dihedral_sums(*orders.order_mesh(spark, sf_dir)), "theta")


def cube_exterior(spark: SparkSession, n: int) -> tuple[DataFrame, ...]:
    v, t = cube.cube_mesh(spark, n)
    edges = topology.adjacency(t)
    ext = exterior.exterior_vertices(v, t)
    return v, t, edges, ext, exterior.exterior_edges(v, t, ext, edges)


@query
def exterior_edges(spark, sf_dir):
    return cube_exterior(spark, CUBE_N)[4]


@query
def sharpness(spark, sf_dir):
    v, _, edges, ext, ext_edges = cube_exterior(spark, CUBE_N)
    return rounded(exterior.sharpness(v, ext, ext_edges, edges), "feature")


@query
def sharpness_order(spark, sf_dir):
    v, _, edges, ext, ext_edges = cube_exterior(spark, 6)
    return exterior.by_feature(exterior.sharpness(v, ext, ext_edges, edges)).select("vid", "rank")


@query
def lumped_mass(spark, sf_dir):
    return rounded(pde.lumped_mass(*orders.order_mesh(spark, sf_dir)), "v")


@query
def stiffness_coo(spark, sf_dir):
    return rounded(pde.stiffness(*cube.cube_mesh(spark, CUBE_N)), "v")


@query
def manufactured_solution(spark, sf_dir):
    return rounded(pde.manufactured_solution(orders.order_vertices(spark, sf_dir)), "v")


@query
def triangles(spark, sf_dir):
    return cliques.triangles(whole_graph(spark, sf_dir))


@query
def four_cliques(spark, sf_dir):
    return cliques.four_cliques(whole_graph(spark, sf_dir))


@query
def quotient_graph(spark, sf_dir):
    return coarsen.quotient(topology.adjacency(orders.order_tets(spark, sf_dir)), labels(spark, sf_dir))


def split_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping edge sets: by keys of even sum, and by keys under a bound."""
    edges = topology.undirected_edges(orders.order_tets(spark, sf_dir))
    return edges.where("(a + b) % 2 = 0"), edges.where("a % 3 = 0")


@query
def graph_union(spark, sf_dir):
    left, right = split_graphs(spark, sf_dir)
    return topology.graph_union(left, right)


@query
def graph_difference(spark, sf_dir):
    left, right = split_graphs(spark, sf_dir)
    return topology.graph_difference(left, right)


@query
def edges_without_inner(spark, sf_dir):
    """Edges but for those between two parts of even key."""
    even = orders.order_vertices(spark, sf_dir).select("vid").where("vid % 2 = 0")
    return coarsen.without_inner(topology.undirected_edges(orders.order_tets(spark, sf_dir)).select(F.col("a").alias("src"), F.col("b").alias("dst")), even)


@query
def complex_surface(spark, sf_dir):
    tets = orders.order_tets(spark, sf_dir)
    return topology.complex_surface(topology.boundary_faces(tets), topology.tet_faces(tets).select("a", "b", "c").distinct())


@query
def surface_depth(spark, sf_dir):
    v, t = cube.cube_mesh(spark, CUBE_N)
    return topology.surface_depth(v, topology.boundary_faces(t))


@query
def nearest_coarse_vertex(spark, sf_dir):
    v = orders.order_vertices(spark, sf_dir)
    centres = v.where("vid % 40 = 0").withColumnRenamed("vid", "coarse_id")
    return rounded(topology.nearest_centre(v, centres).select("vid", "coarse_id", "dist"), "dist")


@query
def surface_remap(spark, sf_dir):
    mapping = labels(spark, sf_dir, 25)
    made = topology.remapped_surface(topology.boundary_faces(orders.order_tets(spark, sf_dir)), mapping)
    return made.select(*topology.canonical("f0", "f1", "f2"))


@query
def spmv(spark, sf_dir):
    return rounded(sparse.spmv(laplacian(spark, sf_dir), ramp(spark, sf_dir)), "v")


@query
def spmv_transposed(spark, sf_dir):
    return rounded(sparse.spmv(sparse.transpose(brands(spark, sf_dir)), ramp(spark, sf_dir)), "v")


@query
def spmm(spark, sf_dir):
    return rounded(sparse.spmm(laplacian(spark, sf_dir), brands(spark, sf_dir)), "v")


@query
def laplacian_squared_rows(spark, sf_dir):
    """Entries and sum of squares of each row of the squared Laplacian; parts of many neighbours make the product uneven."""
    lap = settle(laplacian(spark, sf_dir), "laplacian")
    return sparse.product_row_sums(lap, lap)


@query
def galerkin_rap(spark, sf_dir):
    return rounded(sparse.galerkin(laplacian(spark, sf_dir), brands(spark, sf_dir)), "v")


def fixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ramp(spark, sf_dir).where("i % 10 = 0")


def right_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.spmv(laplacian(spark, sf_dir), ramp(spark, sf_dir))


@query
def dirichlet_matrix(spark, sf_dir):
    return rounded(pde.dirichlet(laplacian(spark, sf_dir), right_side(spark, sf_dir), fixed_values(spark, sf_dir))[0], "v")


@query
def dirichlet_right_side(spark, sf_dir):
    return rounded(pde.dirichlet(laplacian(spark, sf_dir), right_side(spark, sf_dir), fixed_values(spark, sf_dir))[1], "v")


@query
def poisson_matrix(spark, sf_dir):
    v, t = cube.cube_mesh(spark, 6)
    return rounded(pde.system_matrix("poisson", pde.stiffness(v, t), pde.lumped_mass(v, t)), "v")


@query
def biharmonic_matrix(spark, sf_dir):
    v, t = cube.cube_mesh(spark, 6)
    return rounded(pde.system_matrix("biharmonic", pde.stiffness(v, t), pde.lumped_mass(v, t)), "v")


@query
def diag_inverse(spark, sf_dir):
    n = orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("i"))
    return rounded(sparse.inverse_diagonal(laplacian(spark, sf_dir), n), "v")


@query
def zero_diagonals(spark, sf_dir):
    n = orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("i"))
    return sparse.zero_diagonals(laplacian(spark, sf_dir), n)


@query
def vector_add(spark, sf_dir):
    return rounded(sparse.add(ramp(spark, sf_dir), right_side(spark, sf_dir), 1.0, -0.5), "v")


@query
def weighted_norm(spark, sf_dir):
    mass = orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("i"), (1.0 / (1 + F.col("vid") % 5)).alias("v"))
    return rounded(sparse.norm(ramp(spark, sf_dir), mass), "norm")


@query
def relative_error(spark, sf_dir):
    x = ramp(spark, sf_dir)
    return rounded(sparse.relative_norm(x, x.select("i", (F.col("v") + F.col("i") % 3).alias("v"))), "relative")


@query
def jacobi_sweeps(spark, sf_dir):
    a, x = bucketed(laplacian(spark, sf_dir), "j", "matrix")[0], ramp(spark, sf_dir)
    b, x = settle(sparse.spmv(a, x), "right"), x.select("i", F.lit(0.0).alias("v"))
    d = settle(sparse.inverse_diagonal(a, x), "diagonal")
    for omega in G.chebyshev_omegas(2.0):
        x = sparse.jacobi_sweep(a, b, x, d, omega)
    return rounded(x, "v")


@query
def power_iteration(spark, sf_dir):
    """Two steps of x <- D^-1 A x, and the growth of the norm."""
    return rounded(sparse.power_growth(laplacian(spark, sf_dir), ramp(spark, sf_dir)), "growth")


@query
def chebyshev_coefficients(spark, sf_dir):
    """The relaxation weights for a largest eigenvalue that is the largest degree."""
    largest = vertex_degree(spark, sf_dir).agg(F.max("degree").cast("double").alias("m")).first().m
    return rounded(spark.createDataFrame(list(enumerate(G.chebyshev_omegas(largest))), "k int, omega double"), "omega")


@query
def partition_of_unity(spark, sf_dir):
    p = labels(spark, sf_dir).select(F.col("vid").alias("i"), F.col("coarse_id").alias("j"), F.when(F.col("vid") % 100 == 7, 1.25).otherwise(1.0).alias("v"))
    return rounded(sparse.partition_of_unity(p), "worst")


@query
def negative_entries(spark, sf_dir):
    return rounded(sparse.negative_entries(laplacian(spark, sf_dir)), "least")


@query
def cluster_k_hops(spark, sf_dir):
    """The nearest seed of each part over at most two edges, and its distance."""
    v, _, edges = order_edges(spark, sf_dir)
    made = coarsen.cluster(seeds(spark, sf_dir), settle(topology.with_length(edges, v), "edges"), rounds=2)
    return rounded(made.select("vid", "coarse_id", "dist"), "dist")


@query
def cluster_all_hops(spark, sf_dir):
    """The nearest seed of each part over any number of edges, and its distance."""
    v, _, edges = order_edges(spark, sf_dir)
    made = coarsen.cluster(seeds(spark, sf_dir), settle(topology.with_length(edges, v), "edges"))
    return rounded(made.select("vid", "coarse_id", "dist"), "dist")


@query
def two_hop_reach(spark, sf_dir):
    """Shortest paths of up to two edges between parts, under a length of 0.4."""
    v, _, edges = order_edges(spark, sf_dir)
    return rounded(sampling.reach(settle(topology.with_length(edges, v), "edges"), 0.4), "dist")


def grouped_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts (vid, g, q_x, q_y, q_z) and tets with corner positions, by group. Tets have a salt and parts go to every salt, so
    that a group's tets meet its parts in SALTS tasks: the number of pairs, not the size of the rows, is the work."""
    v, t = orders.order_mesh(spark, sf_dir)
    corners = topology.tet_points(t, v).withColumns({"g": F.floor(F.col("v0") / 40), "salt": F.pmod("tid", F.lit(SALTS)).cast("int")})
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    points = labels(spark, sf_dir).join(v, "vid").select("vid", F.col("coarse_id").alias("g"), *G.named(G.point(F.col("x"), F.col("y"), F.col("z")), "q"), salts)
    return points, corners


@query
def best_tet_per_point(spark, sf_dir):
    """For each part the tet of the orders of its group that contains it with the least margin."""
    points, corners = grouped_points(spark, sf_dir)
    corners = G.tet_frames(corners, [f"p{i}" for i in range(4)]).drop(*[f"{n}{i}" for n in "pv" for i in range(4)])
    near = points.join(corners, (points["g"] == corners["g"]) & (points["salt"] == corners["salt"]) & G.in_frame_box(G.held("q")))
    hits = near.select("vid", "tid", r6(G.tet_coordinates(G.held("q"))[1]).alias("metric")).where("metric > -0.5")
    return hits.groupBy("vid").agg(F.min(F.struct("metric", "tid")).alias("top")).select("vid", "top.tid", "top.metric")


@query
def best_triangle_per_point(spark, sf_dir):
    """For each part the triangle v0 v1 v2 of its group's tets whose plane is nearest, if it projects inside."""
    points, corners = grouped_points(spark, sf_dir)
    corners = G.triangle_frames(corners, ["p0", "p1", "p2"]).drop(*[f"{n}{i}" for n in "pv" for i in range(4)])
    hits = points.join(corners, ["g", "salt"]).select("vid", "tid", r6(G.triangle_projection(G.held("q"))[0]).alias("height")).where("height is not null")
    return hits.groupBy("vid").agg(F.min(F.struct("height", "tid")).alias("top")).select("vid", "top.tid", "top.height")


@query
def edge_projection_weights(spark, sf_dir):
    """v0 of each tet projected on its edge v1 v2: the weight of v2, and the distance."""
    v, t = orders.order_mesh(spark, sf_dir)
    p = [F.col(f"p{i}") for i in range(4)]
    return topology.tet_points(t, v).select("tid", r6(G.edge_weight(p[0], p[1], p[2])).alias("w"), r6(G.edge_distance(p[0], p[1], p[2])).alias("away"))


@query
def inverse_distance_weights(spark, sf_dir):
    """Each tet's v0 from its other corners by inverse distances."""
    v, t = orders.order_mesh(spark, sf_dir)
    rows = topology.tet_points(t, v).select(F.col("tid").alias("f"), F.inline(F.array(*[F.struct(F.col(f"v{i}").alias("to"), G.distance(F.col("p0"), F.col(f"p{i}")).alias("d"), F.lit(i).alias("r")) for i in (1, 2, 3)])))
    return prolong.inverse_distance(rows).select("f", "to", r6("v").alias("v"))


@query
def case_histogram(spark, sf_dir):
    cases = orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("f"), (F.col("vid") * 7 % 5).cast("int").alias("kind"))
    return rounded(prolong.case_histogram(cases), "percent")


def order_history(o: DataFrame) -> DataFrame:
    cycle = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").cast("string").alias("problem"), cycle.alias("cycle"), F.col("o_totalprice").alias("residual"), (F.col("o_orderkey") % 10).cast("double").alias("cycle_ms"))


@query
def residual_curve(spark, sf_dir):
    """Orders as the cycles of their customer: prices as residuals, lines as times."""
    return rounded(report.residual_curve(order_history(spark.read.parquet(f"{sf_dir}/orders.parquet"))), "seconds", "relative")


@query
def stage_totals(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    timing = o.select(F.lit(0).alias("level"), F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 100).cast("double").alias("ms"))
    return report.stage_totals(timing)


@query
def count_labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", G.count_label(F.col("o_orderkey") * 1700 + 13).alias("label"))


@query
def cube_disk_sample(spark, sf_dir):
    """The sampling of a cube's vertices, exterior ones in id order first."""
    v, t = cube.cube_mesh(spark, 6)
    edges = settle(topology.with_length(topology.adjacency(t), v), "edges")
    ext = exterior.exterior_vertices(v, t).select("vid", F.col("vid").alias("rank"))
    order = v.select("vid").join(ext, "vid", "left").select("vid", F.coalesce("rank", F.lit(hierarchy.LAST)).alias("rank"), F.col("rank").isNotNull().alias("is_exterior"))
    return sampling.disk_sample(order, edges, 2 ** (1 / 3) * topology.average_length(edges).first().avg_len)[0]


def cube_hierarchy(spark: SparkSession, n: int = 8) -> tuple[DataFrame, DataFrame, hierarchy.Hierarchy]:
    v, t = cube.cube_mesh(spark, n)
    return v, t, hierarchy.build(v, t, hierarchy.demo_settings())


@query
def cube_level_sizes(spark, sf_dir):
    return cube_hierarchy(spark)[2].sizes(spark)


@query
def cube_prolongation(spark, sf_dir):
    return rounded(cube_hierarchy(spark)[2].levels[1].p, "v")


@query
def cube_vcycle_residuals(spark, sf_dir):
    v, t, h = cube_hierarchy(spark)
    result = multigrid.solve_problem(h, pde.assemble_problem(v, t, "poisson"), max_cycles=500)
    return report.residual_curve(multigrid.history(spark, [result])).select("problem", "cycle", "relative")


@query
def ply_round_trip(spark, sf_dir):
    """The order complex, its tets numbered by order key, written as a binary PLY file in parts and read back."""
    v, t = orders.order_mesh(spark, sf_dir)
    numbered = exterior.ranked(t, [F.col("tid")]).select(F.col("rank").cast("bigint").alias("tid"), *[f"v{i}" for i in range(4)])
    folder = current(spark).add("path", f"{shared_folder(spark)}/ply-{uuid.uuid4().hex}")
    folder = folder if "://" in folder else os.path.abspath(folder)
    ply.write_parts(folder, "orders", v, numbered)
    return ply.read_parts(spark, folder, "orders")[1]
