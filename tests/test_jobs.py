import json
import logging
import subprocess
import sys

import duckdb
import pytest

from jobs import mesh_audit, queries, word_graph
from jobs.common import configured, settings
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("part", "lineitem", "orders", "documents"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    sort = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    a, b = sort(got), sort(want)
    for c in columns:
        assert (a[c] == b[c]).all(), c


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def graph(texts):
    """{(a, b): (n, v)} by going through the words."""
    n, sums = {}, {}
    for t in texts:
        w = (t or "").split()
        for x, y in zip(w, w[1:]):
            if x != y:
                n[min(x, y), max(x, y)] = n.get((min(x, y), max(x, y)), 0) + 1
    for (a, b), k in n.items():
        sums[a], sums[b] = sums.get(a, 0) + k, sums.get(b, 0) + k
    return {(a, b): (k, round(k / (sums[a] * sums[b]) ** 0.5, 9)) for (a, b), k in n.items()}


def matrix(df):
    return {(r.a, r.b): (r.n, round(r.v, 9)) for r in df.collect()}


def write(spark, texts, folder, name):
    """A document file beside those that are there."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), folder / name)


def test_word_graph_takes_only_new_files(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    source, output = tmp_path / "in", str(tmp_path / "out")
    first, second = ["a b c b", None, "", "a", "é  a\n\u000bb"], ["b a", "z z z", "c b a " * 2000]
    write(spark, first, source, "documents-1.parquet")
    write(spark, ["not read"], source, "other.parquet")
    assert matrix(word_graph.run(spark, str(source), output)) == graph(first)
    write(spark, second, source, "documents-2.parquet")
    write(spark, second[:1], source, "documents-3.parquet")
    after = word_graph.run(spark, str(source), output, files_per_batch=1)
    assert matrix(after) == graph([*first, *second, second[0]])
    assert rows(spark.read.parquet(f"{output}/counts").select("batch").distinct()) == [(0,), (1,), (2,)]
    marks = [m for m in caplog.messages if "new documents" in m]
    assert [int(m.split()[2]) for m in marks] == [5, 4]
    again = word_graph.run(spark, str(source), output)
    assert matrix(again) == graph([*first, *second, second[0]])
    assert " read 0 new documents" in caplog.messages[-1]


def test_word_graph_repairs_what_a_stopped_run_left(spark, tmp_path, monkeypatch):
    source, output = tmp_path / "in", str(tmp_path / "out")
    write(spark, ["a b c"], source, "documents-1.parquet")
    word_graph.run(spark, str(source), output)
    write(spark, ["c d"], source, "documents-2.parquet")
    with monkeypatch.context() as m:
        m.setattr(word_graph, "assemble", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            word_graph.run(spark, str(source), output)
    assert matrix(word_graph.run(spark, str(source), output)) == graph(["a b c", "c d"])


def test_word_graph_reads_folders_of_files(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    write(spark, ["a b", None], source / "documents.parquet", "part-0.parquet")
    write(spark, ["not read"], source / "other.parquet", "part-0.parquet")
    assert matrix(word_graph.run(spark, str(source), output)) == graph(["a b"])
    write(spark, ["b c"], source / "documents.parquet", "part-1.parquet")
    write(spark, ["c d"], source, "documents-2.parquet")
    assert matrix(word_graph.run(spark, str(source), output)) == graph(["a b", "b c", "c d"])


def test_word_graph_of_no_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert word_graph.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


def test_mesh_audit_replaces_months_alone(spark, tmp_path):
    output = str(tmp_path / "audit")
    whole = rows(mesh_audit.run(spark, SF, output))
    months = sorted({r[-1] for r in whole})
    assert len(months) > 3
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    again = rows(mesh_audit.run(spark, SF, output, months=months[:2], flat=1e9))
    flat = [r for r in again if r[-1] in months[:2]]
    assert [r for r in again if r[-1] not in months[:2]] == [r for r in whole if r[-1] not in months[:2]]
    assert len(again) == len(whole) and all(True in r for r in flat)
    assert rows(mesh_audit.run(spark, SF, output)) == whole
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_settings_and_configuration(spark, tmp_path):
    with pytest.raises(KeyError), settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"months": ["1995-03"], "files": 2}))
    assert configured(spark, str(path), mesh_audit.DEFAULTS) == {"months": ["1995-03"], "flat": 1e-12, "files": 2}
    path.write_text(json.dumps({"month": 3}))
    with pytest.raises(ValueError):
        configured(spark, str(path), mesh_audit.DEFAULTS)
    for job in (mesh_audit, word_graph):
        name = job.__name__.split(".")[1]
        assert set(configured(spark, f"jobs/{name}.json", job.DEFAULTS)) == set(job.DEFAULTS)


def test_command_line(tmp_path):
    said = subprocess.run([sys.executable, "-m", "jobs.mesh_audit", "--tables", SF, "--output", str(tmp_path / "o"), "--config", "jobs/mesh_audit.json"], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "wrote 835 tetrahedra" in said.stderr and (tmp_path / "o/_SUCCESS").exists()
