import numpy as np
import pytest

from meshframe.operators import nearest


def frame(spark, x, name):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], f"{name} long, x double, y double, z double")


def slow(p, q, k):
    d = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(i, r + 1, int(j), d[i, j]) for i in range(len(p)) for r, j in enumerate(order[i])]


def check(spark, p, q, k):
    got = sorted((r.vid, r["rank"], r.coarse_id, r.dist) for r in nearest.nearest_centres(frame(spark, p, "vid"), frame(spark, q, "coarse_id"), k).collect())
    want = slow(p, q, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


@pytest.mark.parametrize("k", [1, 3])
def test_against_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "LEAF", 20)
    monkeypatch.setattr(nearest, "SAMPLED", 2)
    monkeypatch.setattr(nearest, "BLOCK", 60)
    rng = np.random.default_rng(k)
    q = np.concatenate([rng.random((500, 3)), 0.5 + rng.random((300, 3)) * 1e-4, np.repeat(rng.random((1, 3)), 40, axis=0)])
    p = np.concatenate([rng.random((300, 3)), 0.5 + rng.random((500, 3)) * 1e-4, rng.random((50, 3)) * 20 - 10, q[:50]])
    check(spark, p, q, k)


def test_ties_few_and_none(spark):
    grid = np.array([[x, y, 0] for x in range(4) for y in range(4)], float)
    check(spark, grid + 0.5, grid, 3)
    check(spark, grid, grid[:2], 3)
    check(spark, grid, np.repeat(grid[:1], 9, axis=0), 3)
    assert nearest.nearest_centres(frame(spark, grid, "vid"), frame(spark, grid, "coarse_id").limit(0)).count() == 0
    assert nearest.nearest_centres(frame(spark, grid, "vid").limit(0), frame(spark, grid, "coarse_id")).count() == 0


def test_a_dense_region_takes_many_tasks(spark, monkeypatch):
    """Nine points in ten within one thousandth of the box: they are dealt over many blocks."""
    monkeypatch.setattr(nearest, "LEAF", 100)
    monkeypatch.setattr(nearest, "BLOCK", 200)
    rng = np.random.default_rng(5)
    p = np.concatenate([0.3 + rng.random((1800, 3)) * 1e-3, rng.random((200, 3))])
    tree = nearest.grown(p, 4)
    assert np.bincount(tree.leaves(p)).max() < 200
    check(spark, p, p[::7], 1)
