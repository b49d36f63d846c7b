import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import cliques, coarsen, exterior, pde, prolong, sampling, sparse, topology
from meshframe.sources import cube

# Counts of the Kuhn cube by resolution: vertices, tets, boundary faces, boundary vertices, edges.
CUBE = {2: (8, 6, 12, 8, 19), 3: (27, 48, 48, 26, 98), 6: (216, 750, 300, 152, 1115)}


@pytest.fixture(scope="module")
def six(spark):
    v, t = cube.cube_mesh(spark, 6)
    edges = topology.with_length(topology.adjacency(t), v).cache()
    ext = exterior.exterior_vertices(v, t).cache()
    return v, t, edges, ext


@pytest.mark.parametrize("n", CUBE)
def test_cube_counts(spark, n):
    v, t = cube.cube_mesh(spark, n)
    faces = topology.boundary_faces(t)
    edges = topology.adjacency(t)
    assert (v.count(), t.count(), faces.count(), topology.boundary_vertices(t).count(), edges.count() // 2) == CUBE[n]
    assert {r.vid for r in exterior.exterior_vertices(v, t).collect()} == {r.vid for r in topology.boundary_vertices(t).collect()}
    placed = topology.tet_points(t, v)
    six_volumes = G.signed_volume6(*[F.col(f"p{i}") for i in range(4)])
    assert placed.agg(F.min(six_volumes).alias("m"), (F.sum(six_volumes) / 6).alias("s")).first() == (pytest.approx(1 / (n - 1) ** 3), pytest.approx(1.0))


def test_small_resolutions_become_two(spark):
    assert cube.cube_vertices(spark, 0).count() == 8


def test_boundary_faces_point_outwards(six):
    v, t, *_ = six
    faces = topology.located(topology.boundary_faces(t), v, ["f0", "f1", "f2"], ["p", "q", "r"])
    normal = G.cross(G.sub(F.col("q"), F.col("p")), G.sub(F.col("r"), F.col("p")))
    centre = G.point(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    assert faces.where(G.dot(normal, G.sub(F.col("p"), centre)) <= 0).count() == 0


def test_average_length_and_degrees(six):
    _, _, edges, _ = six
    assert topology.average_length(edges).first().avg_len == pytest.approx(0.249847973814)
    degrees = [r.degree for r in topology.vertex_degree(edges).collect()]
    assert (max(degrees), min(degrees), sum(degrees)) == (14, 4, 2 * 1115)
    offsets = topology.csr_offsets(edges).orderBy("vid").collect()
    assert [r["first"] for r in offsets] == [sum(x.degree for x in offsets[:k]) for k in range(len(offsets))]


def test_angles_of_a_corner_tet(spark):
    p = lambda x, y, z: G.point(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))
    o, a, b, c = p(0, 0, 0), p(1, 0, 0), p(0, 1, 0), p(0, 0, 1)
    row = spark.range(1).select(G.solid_angle(o, a, b, c).alias("s"), G.dihedral_angle(o, a, b, c).alias("d"), G.volume(o, a, b, c).alias("v"), G.solid_angle(o, o, b, c).alias("zero"), G.dihedral_angle(o, o, a, b).alias("flat"))
    assert row.first() == (pytest.approx(math.pi / 2), pytest.approx(math.pi / 2), pytest.approx(1 / 6), 0.0, 0.0)


def test_exterior_graph(six):
    v, t, edges, ext = six
    ext_edges = exterior.exterior_edges(v, t, ext, edges).cache()
    surface = topology.boundary_faces(t).select(F.inline(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("f0", "f1"), ("f1", "f2"), ("f0", "f2"))]))).distinct()
    assert ext_edges.count() == surface.count() == surface.join(ext_edges, ["a", "b"]).count()
    feature = {r.vid: r.feature for r in exterior.sharpness(v, ext, ext_edges, edges).collect()}
    assert len(feature) == 152 and feature[0] == pytest.approx(3 * math.pi / 2)
    mid = 2 + 2 * 6  # inside the face z = 0
    assert feature[mid] == pytest.approx(0.0, abs=1e-6)
    order = exterior.by_feature(exterior.sharpness(v, ext, ext_edges, edges)).orderBy("rank").collect()
    assert [r.rank for r in order] == list(range(152)) and [r.vid for r in order] == [k for k, _ in sorted(feature.items(), key=lambda x: (-round(x[1], 6), x[0]))]


def slow_sample(order, near):
    chosen, seen = [], set()
    for v in order:
        if v not in seen:
            chosen.append(v)
            seen |= {v, *near.get(v, {})}
    return chosen


@pytest.mark.parametrize("local", [0, sampling.LOCAL])
def test_disk_sample(six, local):
    v, _, edges, ext = six
    rank = ext.select("vid", F.col("vid").alias("rank"))
    order = v.select("vid").join(rank, "vid", "left").select("vid", F.coalesce("rank", F.lit(1 << 62)).alias("rank"), F.col("rank").isNotNull().alias("is_exterior"))
    radius = 2 ** (1 / 3) * topology.average_length(edges).first().avg_len
    samples, marks = sampling.disk_sample(order, edges, radius, local)
    near: dict = {}
    for r in sampling.reach(edges, radius).collect():
        near.setdefault(r.src, {})[r.dst] = r.dist
    sequence = sorted(r.vid for r in ext.collect())
    want = slow_sample(sequence + sorted({r.vid for r in v.collect()} - set(sequence)), near)
    got = [(r.coarse_id, r.fine_vid, r.is_exterior) for r in samples.orderBy("coarse_id").collect()]
    assert got == [(k, x, x in set(sequence)) for k, x in enumerate(want)] and len(want) == 54 and sum(g[2] for g in got) == 38
    at = {x: k for k, x in enumerate(want)}
    for r in marks.collect():
        options = [(near[s][r.vid], at[s]) for s in want if r.vid in near.get(s, {})] + ([(0.0, at[r.vid])] if r.vid in at else [])
        assert (r.dist, r.coarse_id) == min(options)


def test_clusters_are_shortest_paths(six, spark):
    v, _, edges, _ = six
    rows = edges.collect()
    seeds = [3, 100, 215]
    samples = spark.createDataFrame([(k, s, True) for k, s in enumerate(seeds)], "coarse_id bigint, fine_vid bigint, is_exterior boolean")
    best = {s: (0.0, k) for k, s in enumerate(seeds)}
    for _ in range(40):
        for r in rows:
            if r.src in best:
                step = (best[r.src][0] + r.len, best[r.src][1])
                if r.dst not in best or step < best[r.dst]:
                    best[r.dst] = step
    for r in coarsen.cluster(samples, edges).collect():
        assert r.dist == pytest.approx(best[r.vid][0])
    assert coarsen.cluster(samples, edges).count() == 216


def test_cliques_against_all_subsets(spark):
    import itertools

    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(120)} | {(0, k) for k in range(1, 25)}
    edges = spark.createDataFrame([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs], "src bigint, dst bigint")
    joined = lambda s: all(p in pairs for p in itertools.combinations(s, 2))
    for make, n in ((cliques.triangles, 3), (cliques.four_cliques, 4)):
        assert sorted(map(tuple, make(edges).collect())) == [s for s in itertools.combinations(range(25), n) if joined(s)]


def test_stiffness_and_mass(six):
    v, t, *_ = six
    s = pde.stiffness(v, t).cache()
    assert s.where("i = j").agg(F.sum("v")).first()[0] == pytest.approx(150.0)
    assert sparse.row_sums(s).agg(F.max(F.abs("total"))).first()[0] < 1e-12
    gap = s.join(sparse.transpose(s).withColumnRenamed("v", "w"), ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("w"))), F.count("*")).first()
    assert gap[0] < 1e-12 and gap[1] == s.count()
    assert pde.lumped_mass(v, t).agg(F.sum("v")).first()[0] == pytest.approx(1.0)


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def test_products_over_a_hub_in_blocks(spark, monkeypatch):
    """An index that meets all others on both sides, in blocks of four entries."""
    monkeypatch.setattr(prolong, "BLOCK", 4)
    rng = np.random.default_rng(5)
    m = np.diag(rng.standard_normal(30))
    m[0], m[:, 0] = rng.standard_normal(30), rng.standard_normal(30)
    a = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i bigint, j bigint, v double")
    assert np.allclose(dense(sparse.spmm_in_blocks(a, a), 30, 30), m @ m)
    assert sparse.spmm_in_blocks(a, a.limit(0)).count() == 0


def test_sparse_against_numpy(spark):
    rng = np.random.default_rng(2)
    mats = [np.where(rng.random(s) < 0.4, rng.standard_normal(s), 0) for s in ((7, 7), (7, 3))]
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i bigint, j bigint, v double")
    a, p = map(frame, mats)
    x = rng.standard_normal(7)
    xs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, v double")
    got = {r.i: r.v for r in sparse.spmv(a, xs).collect()}
    assert all(got.get(i, 0.0) == pytest.approx(v) for i, v in enumerate(mats[0] @ x))
    assert np.allclose(dense(sparse.galerkin(a, p), 3, 3), mats[1].T @ mats[0] @ mats[1])
    assert sparse.norm(xs).first().norm == pytest.approx(np.linalg.norm(x))
    assert sparse.relative_norm(xs, xs).first().relative == 0
    fixed = xs.where("i in (1, 4)")
    b = sparse.spmv(a, xs)
    a2, b2 = pde.dirichlet(a, b.unionByName(xs.join(b, "i", "left_anti").select("i", F.lit(0.0).alias("v"))), fixed)
    m, free = mats[0].copy(), [0, 2, 3, 5, 6]
    want = mats[0] @ x - mats[0][:, [1, 4]] @ x[[1, 4]]
    want[[1, 4]] = x[[1, 4]]
    m[[1, 4]], m[:, [1, 4]] = 0, 0
    m[1, 1] = m[4, 4] = 1
    assert np.allclose(dense(a2, 7, 7), m)
    assert {r.i: pytest.approx(r.v) for r in b2.collect()} == dict(enumerate(want)) and free
    n = spark.range(8).withColumnRenamed("id", "i")
    assert sparse.zero_diagonals(a, n).first().n_zero == int((np.abs(np.diag(mats[0])) < 1e-14).sum()) + 1


def test_interpolation_cases(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 0.2, 0.2, 0.2), (5, 0.3, 0.3, -0.1), (6, -0.5, -0.5, -0.5), (7, 5.0, 0.0, 0.0), (8, 5.5, 0.0, 0.0), (9, 9.0, 0.0, 0.0), (10, 9.5, 0.1, 0.0), (11, 10.0, 0.0, 0.0)], "vid bigint, x double, y double, z double")
    fine = [0, 1, 2, 3, 7, 9, 11]
    samples = spark.createDataFrame([(k, f, True) for k, f in enumerate(fine)], "coarse_id bigint, fine_vid bigint, is_exterior boolean")
    label = {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0, 6: 0, 7: 4, 8: 4, 9: 5, 10: 5, 11: 6}
    clusters = spark.createDataFrame([(k, c, 0.0) for k, c in label.items()], "vid bigint, coarse_id bigint, dist double")
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (5, 6)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint")
    p, cases = prolong.interpolation(v, samples, clusters, edges, cliques.triangles(edges), cliques.four_cliques(edges))
    kinds = {r.f: r.kind for r in cases.collect()}
    assert kinds == {**dict.fromkeys(fine, 0), 4: 3, 5: 4, 6: 5, 8: 1, 10: 2}
    rows = {}
    for r in p.collect():
        rows.setdefault(r.i, {})[r.j] = r.v
    assert rows[4] == pytest.approx({0: 0.4, 1: 0.2, 2: 0.2, 3: 0.2}) and rows[10] == pytest.approx({5: 0.5, 6: 0.5})
    assert rows[5] == pytest.approx({0: 0.4, 1: 0.3, 2: 0.3})
    assert all(sum(x.values()) == pytest.approx(1) for x in rows.values())
    empty = edges.select(F.col("src").alias("a"), F.col("src").alias("b"), F.col("src").alias("c"), F.col("src").alias("d")).limit(0)
    q, kinds = prolong.interpolation(v, samples, clusters, edges, empty.drop("d"), empty)
    assert {r.f: r.kind for r in kinds.collect()}[4] == 6
    assert sparse.check_prolongation(q, 12, 7)["unity"]


def test_nearest_centre(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((60, 3)) * 10, rng.random((15, 3))
    frame = lambda m, k: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], f"{k} bigint, x double, y double, z double")
    got = {r.vid: r.coarse_id for r in topology.nearest_centre(frame(a, "vid"), frame(b, "coarse_id")).collect()}
    assert got == dict(enumerate(((a[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()))


def test_row_sums_of_a_product_need_no_products_moved(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = {(int(i), int(j)) for i, j in rng.integers(0, 40, (300, 2))} | {(7, j) for j in range(40)} | {(i, 7) for i in range(40)}
    a = spark.createDataFrame([(i, j, float((i * 5 + j) % 4 - 1)) for i, j in pairs], "i long, j long, v double")
    want = {r.i: (r.n, r.s) for r in sparse.spmm(a, a).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("s")).collect()}
    for grid, cell, step in ((4, 10**6, 10**6), (1, 100, 7), (3, 10**6, 1)):
        for name, value in (("GRID", grid), ("CELL", cell), ("STEP", step)):
            monkeypatch.setattr(sparse, name, value)
        assert {r.i: (r.n_entries, r.sum_squares) for r in sparse.product_row_sums(a, a).collect()} == want
    assert sparse.product_row_sums(a, a.limit(0)).count() == 0
