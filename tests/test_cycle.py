import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import pde, spectral
from meshframe.plans import cycle, hierarchy, multigrid
from meshframe.sources import cube
from tests.test_factor import dense, grid, vector


def prolongation(spark, m):
    """Piecewise constant interpolation from (m/2)^3 blocks."""
    half = m // 2
    at = lambda k: F.floor(F.floor(F.col("i") / m**k) % m / 2)
    return spark.range(m**3).select(F.col("id").alias("i")).select("i", (at(0) + at(1) * half + at(2) * half * half).alias("j"), F.lit(1.0).alias("v"))


def by_arrays(a, ps, omegas, b, cycles, pre=2, post=2):
    """The same cycles on dense arrays."""
    dot = lambda a, x: np.einsum("ij,j...->i...", a, x)  # noqa: E731 - no threaded products beside the JVM
    ops = [a]
    for p in ps:
        ops.append(dot(p.T.copy(), dot(ops[-1], p)))
    last = multigrid.inverted(ops[-1])

    def down(k, x, b):
        if k == len(ps):
            return dot(last, b)
        d = 1 / np.diagonal(ops[k])
        for s in range(pre):
            x = x + omegas[k][s] * d * (b - dot(ops[k], x))
        x = x + dot(ps[k], down(k + 1, np.zeros(ps[k].shape[1]), dot(ps[k].T.copy(), b - dot(ops[k], x))))
        for s in range(post):
            x = x + omegas[k][s] * d * (b - dot(ops[k], x))
        return x

    x, norms = np.zeros(len(b)), [multigrid.length(b)]
    for _ in range(cycles):
        x = down(0, x, b)
        norms.append(multigrid.length(b - dot(a, x)))
    return x, norms


def test_cycles_equal_those_on_arrays(spark):
    a, places = grid(spark, 8, shift=0.01)
    ps = [prolongation(spark, 8), prolongation(spark, 4)]
    b = np.random.default_rng(1).standard_normal(512)
    solver = cycle.TableCycle(a, places.select("i"), ps, places, bound=True)
    x, norms = solver.solve(spark.createDataFrame(list(enumerate(b.tolist())), "i long, v double"), max_cycles=2, tolerance=0.0)
    full = dense(a, 512)
    flat = [np.zeros((512, 64)), np.zeros((64, 8))]
    for out, p in zip(flat, ps, strict=True):
        for r in p.collect():
            out[r.i, r.j] = r.v
    want, sizes = by_arrays(full, flat, [x.omegas for x in solver.levels[:-1]], b, 2)
    assert np.abs(vector(x, 512) - want).max() < 1e-10 and np.allclose(norms, sizes, rtol=1e-9)


def test_no_exchange_between_operator_and_vector(spark):
    """With both in buckets a product has one exchange, that of its partial sums."""
    a, places = grid(spark, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        solver = cycle.TableCycle(a, places.select("i"), [prolongation(spark, 4)], places, bound=True)
        state = cycle.table(places.select("i", F.lit(1.0).alias("x"), F.lit(1.0).alias("b"), F.lit(1.0).alias("d")), "i", "state")
        plan = solver.swept(0, state.df, 0.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2


def test_a_problem_over_tables_converges_like_arrays(spark):
    v, t = cube.cube_mesh(spark, 7)
    h = hierarchy.build(v, t, hierarchy.demo_settings())
    problem = pde.assemble_problem(v, t, "poisson")
    small = multigrid.solve_problem(h, problem, 100)
    large = multigrid.solve_problem(h, problem, 100, local_rows=10)
    assert large.converged and large.coarse_solver_name == "sparse factors" and not len(large.x)
    assert large.relative_residual <= 1e-7 and large.relative_error <= 1e-4
    assert np.abs(vector(large.solution, 343) - small.x).max() < 1e-6
    assert abs(large.num_cycles - small.num_cycles) <= 2


def test_lanczos(spark):
    a, places = grid(spark, 6)
    want = (6.1 + 6 * np.cos(np.pi / 7)) / 6.1  # of the grid's sines
    got = spectral.largest_eigenvalue(a, places.select("i"), steps=25)
    assert abs(got - spectral.SAFETY * want) < 1e-6 and spectral.row_bound(a) >= want - 1e-12
    one = spark.createDataFrame([(0, 0, 4.0)], "i long, j long, v double")
    assert spectral.largest_eigenvalue(one, one.select("i"), safety=1.0) == pytest.approx(1.0)
    assert spectral.largest_eigenvalue(one.limit(0), one.select("i").limit(0)) == 0.0


def test_tridiagonal():
    rng = np.random.default_rng(2)
    alpha, beta = rng.standard_normal(9), rng.standard_normal(8)
    want = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))[-1]  # 9 rows: one thread
    assert spectral.largest_of_tridiagonal(alpha.tolist(), beta.tolist()) == pytest.approx(want, abs=1e-12)


def test_lanczos_steps_write_blocks_not_rows(spark, monkeypatch):
    """A block of ids is one row of the vectors; blocks change no coefficient."""
    a, places = grid(spark, 6)
    whole = spectral.lanczos(a, places.select("i"), 4)
    kept, rows = spectral.bucketed, []

    def watched(df, key, label):
        made = kept(df, key, label)
        rows.append((label, made[0].count()))
        return made

    monkeypatch.setattr(spectral, "bucketed", watched)
    monkeypatch.setattr(spectral, "BLOCK", 40, raising=False)
    for odd, want in ((False, 6), (True, None)):  # ids close together, and one far away
        b, r = a, places.select("i")
        if odd:
            far = lambda c: F.when(F.col(c) == 215, 1 << 40).otherwise(F.col(c)).alias(c)
            b, r = a.select(far("i"), far("j"), "v"), r.select(far("i"))
        rows.clear()
        got = spectral.lanczos(b, r, 4)
        assert all(n <= 40 for label, n in rows if label == "lanczos") and rows
        if want:
            assert {n for label, n in rows if label == "lanczos"} == {want}
            assert np.allclose(got[0], whole[0], atol=1e-12) and np.allclose(got[1], whole[1], atol=1e-12)
