"""The public surface: objects, settings, command lines, and small operators without a query."""

import json
import math
import os

import numpy as np
import pytest

import meshframe
from meshframe import storage
from meshframe.functions import geometry as G
from meshframe.operators import coarsen, exterior, report, topology
from meshframe.plans import demo, hierarchy, multigrid
from meshframe.sources import cube, parts, ply


@pytest.fixture(scope="module")
def solver(spark):
    made = meshframe.create_solver(meshframe.make_cube_mesh(spark, 8))
    made.build_hierarchy()
    return made


def test_exports():
    assert meshframe.version() == meshframe.__version__
    assert all(callable(getattr(meshframe, name)) for name in meshframe.__all__)
    with pytest.raises(AttributeError):
        meshframe.nothing  # noqa: B018


def test_solver_reports_its_state(spark, solver):
    fresh = meshframe.Solver(solver.mesh)
    assert not fresh.is_hierarchy_built() and not fresh.num_levels() and not fresh.is_converged() and fresh.residual_history() == []
    assert solver.mesh.num_vertices() == 512 and solver.mesh.num_tetrahedra() == 6 * 7**3
    assert solver.is_hierarchy_built() and solver.level_sizes()[0] == 512 and solver.num_levels() == len(solver.level_sizes())
    assert solver.solve("poisson", 500).coarse_solver_name == "dense" and solver.is_converged() and len(solver.residual_history()) > 1


def test_coarse_solvers_agree_and_an_indefinite_operator_raises(spark, solver):
    problem = meshframe.assemble_problem(*solver.mesh, "poisson")
    dense = meshframe.solve_problem(solver.hierarchy, problem, 500)
    loose = meshframe.solve_problem(solver.hierarchy, problem, 500, dense_coarse=False)
    assert loose.coarse_solver_name == "conjugate gradients" and loose.converged and np.allclose(dense.x, loose.x, atol=1e-6)
    negative = problem.a.selectExpr("i", "j", "-v as v")
    with pytest.raises(ValueError, match="positive definite"):
        multigrid.VCycle(negative, [x.p for x in solver.hierarchy.levels[1:]], solver.level_sizes())


def test_settings(spark, capsys):
    v, t = cube.cube_mesh(spark, 6)
    sharp, plain = (hierarchy.finest(v, t, hierarchy.Settings(feature_preserve=f, verbose=True)) for f in (True, False))
    assert "sharpest:" in capsys.readouterr().out
    ranks = {r.vid: r["rank"] for r in plain.exterior.collect()}
    assert all(k == r for k, r in ranks.items()) and {r.vid for r in sharp.exterior.collect()} == set(ranks)


def test_timing_is_written_when_a_level_fails(spark, tmp_path, monkeypatch):
    v, t = cube.cube_mesh(spark, 6)
    monkeypatch.setattr(hierarchy, "coarser", lambda h, s: 1 / 0)
    path = tmp_path / "timing.json"
    with pytest.raises(ZeroDivisionError):
        hierarchy.build(v, t, hierarchy.demo_settings(), str(path))
    said = json.loads(path.read_text())
    assert said["num_vertices_start"] == 216 and said["level_sampling_ms"] == [] and said["total_hierarchy_ms"] > 0
    assert len([k for k in said if k.startswith("level_")]) == 9


def test_check_mesh(spark):
    v, t = cube.cube_mesh(spark, 3)
    topology.check_mesh(v, t)
    for bad in ((0, 1, 2, 99), (0, 1, 2, 2)):
        with pytest.raises(ValueError, match="missing|twice"):
            topology.check_mesh(v, spark.createDataFrame([(0, *bad)], t.schema))
    with pytest.raises(ValueError, match="repeat"):
        topology.check_mesh(v.unionByName(v.limit(1)), t)
    many = spark.createDataFrame([(k, 0, 1, 2, 100 + k) for k in range(9)], t.schema)
    with pytest.raises(ValueError) as told:
        topology.check_mesh(v, many)
    assert str(told.value).count("vid") == 5


def test_orders_of_vertices(spark):
    v, t = cube.cube_mesh(spark, 3)
    sums = exterior.solid_angle_sums(v, t)
    got = exterior.by_solid_angle(sums).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(27)) and all(a.omega <= b.omega for a, b in zip(got, got[1:], strict=False))
    assert got[-1].omega == pytest.approx(4 * math.pi)
    rows = spark.createDataFrame([(k, float(k % 5)) for k in range(30)], "vid bigint, feature double")
    assert [(r.vid, r.feature) for r in exterior.sharpest(rows, 3).collect()] == [(4, 4.0), (9, 4.0), (14, 4.0)]
    lists = {r.vid: list(r.nbrs) for r in topology.neighbour_lists(topology.adjacency(t)).collect()}
    assert len(lists) == 27 and all(x == sorted(set(x)) and k not in x for k, x in lists.items())


def test_standard_coarsening_is_a_quotient_of_nearest_samples(spark):
    v, t = cube.cube_mesh(spark, 4)
    edges = storage.settle(topology.with_length(topology.adjacency(t), v), "edges")
    samples = spark.createDataFrame([(0, 0, True), (1, 63, True)], "coarse_id bigint, fine_vid bigint, is_exterior boolean")
    clusters, coarse = coarsen.standard(samples, edges)
    at = {r.vid: r for r in clusters.collect()}
    assert len(at) == 64 and at[0].dist == 0 and at[63].coarse_id == 1 and {r.coarse_id for r in at.values()} == {0, 1}
    assert sorted(tuple(r) for r in coarse.collect()) == [(0, 1), (1, 0)]


def test_report_rows(spark):
    got = report.phase_bars(spark.createDataFrame([("poisson", 1000.0, 500.0, 250.0)], "problem string, hierarchy_build_ms double, setup_time_ms double, total_time_ms double"))
    assert [(r.phase, r.seconds) for r in got.collect()] == [("hierarchy", 1.0), ("setup", 0.5), ("solve", 0.25)]
    timing = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0)], "level int, stage string, ms double")
    assert report.timing_drift(timing, 16.0).first().over is False and report.timing_drift(timing, 30.0).first().over is True


def test_geometry_values(spark):
    rows = spark.createDataFrame([(0.0,), (4.0,), (1e-20,)], "v double")
    assert [r[0] for r in rows.select(G.safe_inverse(rows.v, 1e-14)).collect()] == [0.0, 0.25, 0.0]
    p = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert tuple(p.select(G.render_rotation(G.point(p.x, p.y, p.z)).alias("p")).first().p) == (1.0, -3.0, 2.0)


def test_parts_assemble_lazily_and_by_command_line(spark, tmp_path, capsys):
    folder, target = tmp_path / "parts", tmp_path / "data"
    folder.mkdir()
    target.mkdir()
    v, t = cube.cube_mesh(spark, 3)
    ply.write_tet_ply(str(tmp_path / "cube.ply"), v, t)
    parts.write_manifest(str(folder), {"cube": parts.split(str(tmp_path / "cube.ply"), str(folder), 100)})
    mesh = meshframe.make_mesh_from_ply(spark, str(target / "cube.ply"), str(folder))
    assert mesh.num_tetrahedra() == 48
    os.unlink(target / "cube.ply")
    assert parts.main(["--parts", str(folder), "--target", str(target), "cube"]) == 0 and (target / "cube.ply").exists()
    assert parts.main(["--parts", str(folder), "--target", str(target)]) == 0 and "there already" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parts.main(["--parts", str(folder), "none"])
    with pytest.raises(FileNotFoundError):
        ply.read_mesh(spark, str(tmp_path / "none.ply"), str(folder))


def test_batch_import(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n4 0 1 2 {last}\n"
    (tmp_path / "a.ply").write_text(text.replace("{last}", "3"))
    assert ply.import_all(spark, str(tmp_path), str(tmp_path / "out"), {"a.ply": "b.ply", "c.ply": "d.ply"}) == {"a.ply": True, "c.ply": False}
    assert ply.read_tets(spark, str(tmp_path / "out" / "b.ply")).count() == 1
    (tmp_path / "a.ply").write_text(text.replace("{last}", "9"))
    with pytest.raises(ValueError, match="four vertices"):
        ply.import_all(spark, str(tmp_path), str(tmp_path / "out"), {"a.ply": "b.ply"})


def test_smoke_verdict_and_clean(tmp_path):
    good = {"converged": True, "timed_out": False, "relative_residual": 1e-9, "tolerance": 1e-8, "relative_error": 1e-6}
    assert demo.accepted({"problems": {"p": good}}) == []
    assert len(demo.accepted({"problems": {"p": good | {"converged": False, "relative_error": 1.0}}})) == 2
    for name in ("summary.json", "level_00.ply", "mine.txt"):
        (tmp_path / name).write_text("x")
    assert demo.main(["--clean", "--output", str(tmp_path)]) == 0 and os.listdir(tmp_path) == ["mine.txt"]


def test_scopes_delete_their_own(spark):
    outside = storage.settle(spark.range(3))
    with storage.scope(spark) as own:
        inside, path = storage.settled(spark.range(4))
    assert inside.count() == 4 and own.made == [("path", path)]
    own.close()
    assert not os.path.exists(path) and outside.count() == 3
