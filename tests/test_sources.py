import json
import os

import numpy as np
import pytest

from meshframe.plans import demo, hierarchy
from meshframe.sources import cube, parts, ply
from meshframe.streaming import face_counts, read_tets


def test_binary_ply(spark, tmp_path):
    path = str(tmp_path / "cube.ply")
    v, t = cube.cube_mesh(spark, 4)
    ply.write_tet_ply(path, v, t)
    got_v, got_t = ply.read_mesh(spark, path)
    parted = spark.read.format("tetply").option("element", "tets").option("rows", 50).load(path)
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, t.collect()))
    assert parted.rdd.getNumPartitions() == 4 and sorted(map(tuple, got_t.collect())) == sorted(map(tuple, t.collect()))
    assert np.allclose(sorted(map(tuple, got_v.collect())), sorted(map(tuple, v.collect())), atol=1e-6)


def test_parts_written_by_tasks(spark, tmp_path):
    v, t = cube.cube_mesh(spark, 5)
    folder, one = tmp_path / "parts", tmp_path / "one.ply"
    entry = ply.write_parts(f"file://{folder}", "cube", v.repartition(7), t.repartition(5))
    assert len(entry["parts"]) > 4
    parts.write_manifest(str(folder), {"cube": entry})
    assert parts.assemble(str(folder), "cube", str(tmp_path / "cube.ply"))
    ply.write_tet_ply(str(one), v, t)
    assert (tmp_path / "cube.ply").read_bytes() == one.read_bytes()
    got_v, got_t = ply.read_parts(spark, f"file://{folder}", "cube")
    assert got_v.count() == 125 and sorted(map(tuple, got_t.collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, ply.read_tets(spark, f"file://{one}").collect())) == sorted(map(tuple, t.collect()))
    with pytest.raises(Exception, match="count from 0|follow each other"):
        ply.write_parts(str(tmp_path / "gap"), "x", v.where("vid <> 60"), t)
    assert not (tmp_path / "gap" / "x.vertices.json").exists()


def test_lines_of_a_text_file_over_many_partitions(spark, tmp_path):
    path = tmp_path / "a.ply"
    n = 2000
    path.write_text(TEXT.split("element vertex")[0] + f"element vertex {n}\nproperty float x\nproperty float y\nproperty float z\nelement face {n}\nproperty list uchar int vertex_indices\nend_header\n" + "".join(f"{k} 0 0\n" for k in range(n)) + "".join(f"4 {k} 0 1 2\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        v, t = ply.read_mesh(spark, str(path))
        assert all(r.x == r.vid for r in v.collect()) and all(r.v0 == r.tid for r in t.collect()) and t.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


TEXT = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n0 0 1.5\n{n} 0 1 2 3\n"


def test_text_ply(spark, tmp_path):
    source, target = tmp_path / "a.ply", tmp_path / "b.ply"
    source.write_text(TEXT.replace("{n}", "4"))
    assert ply.import_tetgen(spark, str(source), str(target)) and not ply.import_tetgen(spark, str(tmp_path / "none"), str(target))
    v, t = ply.read_mesh(spark, str(target))
    assert [tuple(r) for r in v.orderBy("vid").collect()][3] == (3, 0.0, 0.0, 1.5) and t.first() == (0, 0, 1, 2, 3)
    source.write_text(TEXT.replace("{n}", "3"))
    with pytest.raises(Exception, match="tetrahedron"):
        ply.read_tets(spark, str(source)).collect()


def test_bad_headers(spark, tmp_path):
    for text in ("no", "ply\nformat binary_big_endian 1.0\nend_header\n", "ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty float w\nend_header\n"):
        (tmp_path / "x.ply").write_text(text)
        with pytest.raises(ValueError):
            ply.read_header(str(tmp_path / "x.ply"))
    with pytest.raises(FileNotFoundError):
        ply.read_tets(spark, str(tmp_path / "missing.ply"))


def test_parts(tmp_path):
    source = tmp_path / "m.ply"
    source.write_bytes(os.urandom(1000))
    folder = tmp_path / "chunks"
    folder.mkdir()
    entry = parts.split(str(source), str(folder), 300)
    parts.write_manifest(str(folder), {"m": entry})
    assert len(entry["parts"]) == 4 and entry["size"] == 1000
    out = tmp_path / "out"
    out.mkdir()
    assert parts.assemble_all(str(folder), str(out)) == ["m"] and (out / "m.ply").read_bytes() == source.read_bytes()
    assert not parts.assemble(str(folder), "m", str(out / "m.ply")) and parts.assemble(str(folder), "m", str(out / "m.ply"), force=True)
    with pytest.raises(KeyError):
        parts.assemble(str(folder), "x", "y")
    (folder / entry["parts"][1]).write_bytes(b"x" * 300)
    with pytest.raises(ValueError, match="has changed"):
        parts.assemble(str(folder), "m", str(out / "n.ply"))
    again = parts.split(str(source), str(folder), 600)
    assert len(again["parts"]) == 2 and sorted(p.name for p in folder.glob("*part*")) == again["parts"] and not list(folder.glob(".m*"))
    (folder / entry["parts"][0]).unlink()
    with pytest.raises(FileNotFoundError):
        parts.assemble(str(folder), "m", str(out / "n.ply"))


def test_suite_writes_its_files(spark, tmp_path):
    out = tmp_path / "run"
    made = demo.run_demo(spark, "cube", lambda s: cube.cube_mesh(s, 5), output=str(out), problems=["poisson"], settings=hierarchy.Settings(min_verts=60, max_levels=3))
    assert made["problems"]["poisson"]["converged"]
    assert json.loads((out / "summary.json").read_text())["hierarchy_levels"] == made["hierarchy_levels"]
    with np.load(out / "prolongations.npz") as z:
        assert tuple(z["P_0_shape"])[0] == 125 and len(z["P_0_indptr"]) == 126
    assert ply.read_header(str(out / "level_00.ply")).vertices == 125
    assert json.loads((out / "hierarchy_timing.json").read_text())["num_vertices_start"] == 125


def test_stream_of_tets(spark, tmp_path):
    folder = str(tmp_path / "tets")
    cube.cube_tets(spark, 3).write.parquet(folder)
    q = face_counts(read_tets(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("face_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM face_counts WHERE n = 1").first()[0] == 48
