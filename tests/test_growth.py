"""What grows faster than the tables, or stands still where it should grow: plans and files of single steps."""

import glob
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobs import word_graph
from meshframe.operators import exterior, factor, sampling, sparse, topology
from meshframe.plans import catalog, levels
from meshframe.sources import orders
from meshframe.storage import CLEANUP, bucketed, settle
from tests.conftest import SF


def plan_of(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")


def test_pairs_of_points_and_cliques_take_plain_products(spark):
    for name in ("best_tet_per_point", "best_triangle_per_point"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        pairs = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if "Join" in x and "salt" in x]
        assert pairs and not any("transform(" in x for x in pairs)


def test_sums_of_angles_meet_the_edges_not_points(spark):
    v, t = orders.order_mesh(spark, SF)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(exterior.dihedral_sums(v, t, topology.undirected_edges(t).where("a % 3 = 0"))).split("== Physical Plan ==")[1].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    meet = next(k for k, x in enumerate(lines) if "LeftSemi" in x)
    total = next(k for k, x in enumerate(lines) if "sum(theta" in x)
    assert meet < total  # the plan reads from the top: the join is the later step


def test_reach_from_some_starts(spark):
    edges = spark.createDataFrame([(a, b, 0.1) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3))], "src long, dst long, len double")
    some = sampling.reach(edges, 0.25, spark.createDataFrame([(1,), (4,)], "src long"))
    assert sorted(some.collect()) == sorted(sampling.reach(edges, 0.25).where("src in (1, 4)").collect()) and some.count() == 4


def test_sample_takes_no_exterior_edges(spark, monkeypatch):
    def never(*_):
        raise AssertionError("exterior edges are not needed")

    monkeypatch.setattr(exterior, "exterior_edges", never)
    assert levels.disk_sample(spark, SF).count()


def test_graph_steps_lower_the_size_of_merged_partitions(spark):
    name, v, t = "spark.sql.adaptive.advisoryPartitionSizeInBytes", *orders.order_mesh(spark, SF)
    before = spark.conf.get(name)
    steps = (lambda: topology.undirected_edges(t), lambda: exterior.dihedral_sums(v, t), lambda: catalog.complex_surface(spark, SF))
    try:
        for step in steps:
            spark.conf.unset(name)
            step()
            assert spark.conf.get(name) == "16MB"
        spark.conf.set(name, "40MB")
        steps[0]()
        assert spark.conf.get(name) == "40MB"  # a chosen size stays
    finally:
        spark.conf.set(name, before)


def streamed(own, columns):
    """Batches of a block's entries (i, k, v) and of columns (at, k, v), as a task gets them."""
    yield pa.RecordBatch.from_pydict({"at": pa.nulls(len(own[0]), pa.int64()), "k": own[1], "v": own[2], "i": own[0]})
    for low in range(0, len(columns[0]), 1000):
        at, k, v = (x[low : low + 1000] for x in columns)
        yield pa.RecordBatch.from_pydict({"at": at, "k": k, "v": v, "i": pa.nulls(len(at), pa.int64())})


def test_a_block_of_a_product_holds_few_of_the_columns_that_it_meets(monkeypatch):
    rng = np.random.default_rng(8)
    own = [np.repeat(np.arange(40), 10), rng.integers(0, 300, 400), rng.integers(-2, 3, 400).astype(float)]
    left = np.zeros((40, 300))
    np.add.at(left, (own[0], own[1]), own[2])
    columns = [np.repeat(np.arange(100), 300), np.tile(np.arange(300), 100), rng.integers(-2, 3, 30_000).astype(float)]
    want = left @ columns[2].reshape(100, 300).T
    for step, taken in ((2_000_000, 100_000), (50, 10), (1500, 1), (10**6, 700)):
        monkeypatch.setattr(sparse, "STEP", step)
        monkeypatch.setattr(sparse, "TAKEN", taken)
        made = pa.Table.from_batches(sparse.row_sums_of_block(streamed(own, columns)))
        assert made["i"].to_pylist() == list(range(40)) and set(made["n_entries"].to_pylist()) == {100}
        assert np.allclose(made["sum_squares"].to_numpy(), (want**2).sum(axis=1))
    monkeypatch.undo()
    long = [np.repeat(np.arange(3000), 300), np.tile(np.arange(300), 3000), np.ones(900_000)]
    tracemalloc.start()
    try:
        assert next(sparse.row_sums_of_block(streamed(own, long))).num_rows == 40
        assert tracemalloc.get_traced_memory()[1] < 45 << 20  # nothing that grows with the columns
    finally:
        tracemalloc.stop()


def shuffles(spark):
    """Shuffle files in the folders of this process."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def left_by(spark, step):
    before, flag = shuffles(spark), spark.conf.get(CLEANUP, None)
    step()
    for _ in range(50):  # files are removed in the background
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert spark.conf.get(CLEANUP, None) == flag
    return left


def test_what_is_written_leaves_no_shuffle_files(spark, tmp_path):
    counted = spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count()
    documents = tmp_path / "in"
    spark.createDataFrame([("a b c a b",), ("b c d",)], "text string").write.parquet(str(documents / "documents.parquet"))
    spark.conf.set(CLEANUP, "false")
    try:
        assert left_by(spark, lambda: counted.write.parquet(str(tmp_path / "plain")))
        assert not left_by(spark, lambda: settle(counted)) and not left_by(spark, lambda: bucketed(counted, "k"))
        made = []
        left = left_by(spark, lambda: made.append(word_graph.run(spark, str(documents), str(tmp_path / "out"))))
        assert len({f.split("/shuffle_")[1].split("_")[0] for f in left}) <= 2 and made[0].count() == 4  # of a maximum and of a count
    finally:
        spark.conf.unset(CLEANUP)
    assert not [f for f in glob.glob(str(tmp_path / "out/work/*/*.parquet")) if spark.read.parquet(f).count()]


def test_third_corners_at_some_edges(spark):
    tris = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (2, 3, 4)], "a long, b long, c long")
    some = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")
    assert sorted(map(tuple, exterior.opposite(tris, "ks", some).collect())) == [(1, 2, [3, 4]), (2, 3, [1, 4])]
    assert exterior.opposite(tris, "ks").count() == 6


def test_few_fronts_share_a_file(spark, monkeypatch):
    monkeypatch.setattr(factor, "TOGETHER", 4)
    n = 24
    places = spark.range(n * n).select(F.col("id").alias("i"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), F.lit(0.0).alias("z"))
    links = [(i, j) for i in range(n * n) for j in ([i + 1] if i % n < n - 1 else []) + ([i + n] if i + n < n * n else [])]
    a = spark.createDataFrame([(i, j, -1.0) for p in links for i, j in (p, p[::-1])] + [(i, i, 5.0) for i in range(n * n)], "i long, j long, v double")
    made = factor.factorise(a, places, 5)
    held = [r["count"] for r in made.fronts[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 32 and len(held) > 4 and max(held) < 12  # shuffles of 4 partitions would leave 4 files at most
    x = factor.solve(made, sparse.spmv(a, places.select("i", F.col("x").alias("v")))).collect()
    assert len(x) == n * n and all(abs(r.v - r.i % n) < 1e-9 for r in x)
