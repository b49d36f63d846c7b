import pytest

from meshframe.operators import pde, report, sparse
from meshframe.plans import hierarchy, multigrid
from meshframe.sources import cube


@pytest.fixture(scope="module")
def ten(spark):
    v, t = cube.cube_mesh(spark, 10)
    return v, t, hierarchy.build(v, t, hierarchy.demo_settings())


def test_hierarchy_invariants(ten):
    _, _, h = ten
    assert [x.n for x in h.levels][0] == 1000 and all(b.n < a.n for a, b in zip(h.levels, h.levels[1:], strict=False)) and h.levels[-1].n <= 200
    for low, high in zip(h.levels, h.levels[1:], strict=False):
        checks = sparse.check_prolongation(high.p, low.n, high.n, 3e-5)
        assert all(checks.values()), checks
    assert hierarchy.mapped_surface(h, 1).count() > 0 and hierarchy.surface(h, 1).count() > 0


@pytest.mark.parametrize("name", ["poisson", "biharmonic"])
def test_smoke_acceptance(ten, spark, name):
    v, t, h = ten
    problem = pde.assemble_problem(v, t, name)
    r = multigrid.solve_problem(h, problem, max_cycles=500)
    assert r.converged and not r.timed_out and r.relative_residual <= max(10 * r.tolerance, 1e-10) and r.relative_error <= 1e-4
    curve = report.residual_curve(multigrid.history(spark, [r])).orderBy("cycle").collect()
    assert curve[0].relative == 1.0 and curve[-1].relative == pytest.approx(r.residual_history[-1] / r.residual_history[0])


def test_errors(spark):
    v, t = cube.cube_mesh(spark, 2)
    h = hierarchy.build(v, t, hierarchy.demo_settings())
    with pytest.raises(ValueError):
        multigrid.solve_problem(h, pde.assemble_problem(v, t, "poisson"))
    with pytest.raises(ValueError):
        pde.assemble_problem(v, t, "heat")
