"""The queries on whole tables against brute force over a small order complex."""

import heapq
import itertools
import math
from collections import defaultdict

import pytest

from meshframe.plans import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def tets(spark):
    parts = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        parts[r.l_orderkey].add(r.l_partkey)
    return {o: sorted(p)[:4] for o, p in parts.items() if len(p) >= 4}


@pytest.fixture(scope="module")
def near(tets):
    out = defaultdict(set)
    for t in tets.values():
        for a, b in itertools.permutations(t, 2):
            out[a].add(b)
    return out


def rows(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def test_cliques_of_all_edges(spark, near):
    three = [(a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c]
    four = [(a, b, c, d) for a, b, c in three for d in near[a] & near[b] & near[c] if c < d]
    got = rows(spark, "triangles")
    assert sorted(got) == sorted(three) and any((a + b) % 2 for a, b, _ in got)
    assert sorted(rows(spark, "four_cliques")) == sorted(four)


def test_residual_curves_of_all_customers(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_orderkey").collect():
        by[r.o_custkey].append((r.o_orderkey % 10, r.o_totalprice))
    want = {}
    for c, held in by.items():
        for k, (_, price) in enumerate(held):
            want[str(c), k] = (sum(ms for ms, _ in held[: k + 1]) / 1000, price / held[0][1])
    got = {(p, c): (s, r) for p, c, s, r in rows(spark, "residual_curve")}
    assert set(got) == set(want) and max(int(p) for p, _ in got) > 50
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_reach_of_all_parts(spark, near):
    at = {r.vid: (r.x, r.y, r.z) for r in catalog.orders.order_vertices(spark, SF).collect()}
    length = {(a, b): math.dist(at[a], at[b]) for a in near for b in near[a]}
    want = {k: d for k, d in length.items() if d < 0.4}
    for (a, m), d in length.items():
        for b in near[m] - {a}:
            if d + length[m, b] < 0.4:
                want[a, b] = min(want.get((a, b), 1.0), d + length[m, b])
    got = {(a, b): d for a, b, d in rows(spark, "two_hop_reach")}
    assert set(got) == set(want) and any(a % 40 for a, _ in got)
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_surface_with_the_faces_of_all_tets(spark, tets):
    got = rows(spark, "complex_surface")
    assert {tuple(sorted(f)) for f in got} == {f for t in tets.values() for f in itertools.combinations(t, 3)}
    assert len(got) == len({frozenset(f) for f in got})
    outer = set(rows(spark, "oriented_boundary"))
    assert outer <= set(got) and all(f == tuple(sorted(f)) for f in set(got) - outer)


def test_clusters_over_any_number_of_edges(spark, near):
    vertices = catalog.orders.order_vertices(spark, SF).collect()
    at = {r.vid: (r.x, r.y, r.z) for r in vertices}
    best, heap = {}, [(0.0, v // 40, v) for v in at if v % 40 == 0]
    heapq.heapify(heap)
    while heap:
        d, c, a = heapq.heappop(heap)
        if a not in best:
            best[a] = (d, c)
            for b in near[a]:
                heapq.heappush(heap, (d + math.dist(at[a], at[b]), c, b))
    got = {v: (d, c) for v, c, d in rows(spark, "cluster_all_hops")}
    assert set(got) == set(best) and all(got[v][0] == pytest.approx(best[v][0], abs=2e-6) for v in best)
    assert all(got[v][1] == best[v][1] for v in best)
    two = {r.vid: r.dist for r in catalog.cluster_k_hops(spark, SF).collect()}
    assert set(two) < set(got) or any(got[v][0] < d for v, d in two.items())


def test_sampling_rounds_follow_chains(spark):
    """A path in id order is settled by few rounds, and any graph like the sequence."""
    import random

    from pyspark.sql import functions as F

    from meshframe.operators import sampling

    n = 400
    path = [(k, k + 1) for k in range(n - 1)]
    rng = random.Random(6)
    loose = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(500)})
    for pairs in (path, loose, []):
        near = spark.createDataFrame([(a, b) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long")
        priority = spark.range(n).select(F.col("id").alias("vid"), (F.col("id") / 7).cast("long").alias("rank"))
        around = {}
        for x, y in pairs:
            around.setdefault(x, set()).add(y)
            around.setdefault(y, set()).add(x)
        seen, want = set(), []
        for v in range(n):
            if v not in seen:
                want.append(v)
                seen |= {v, *around.get(v, ())}
        assert sorted(r.vid for r in sampling.pick_rounds(priority, near).collect()) == want
    ends, _ = sampling.chain_ends(spark.createDataFrame([(k + 1, k, True) for k in range(300)], "vid long, rival long, odd boolean"))
    assert {(r.vid, r.rival, r.odd) for r in ends.collect()} == {(k, 0, k % 2 == 1) for k in range(1, 301)}


def test_heavy_centres_meet_in_blocks(spark, monkeypatch):
    from meshframe.operators import prolong

    monkeypatch.setattr(prolong, "BLOCK", 5)
    points = spark.createDataFrame([(f, f % 3 if f % 2 else 7) for f in range(60)], "f long, c long")
    lists = spark.createDataFrame([(c, k) for c, n in ((7, 23), (1, 2), (9, 4)) for k in range(n)], "c long, k long")
    got = sorted((r.f, r.c, r.k) for r in prolong.met(points, lists).collect())
    assert got == sorted((p.f, p.c, q.k) for p in points.collect() for q in lists.collect() if p.c == q.c)


def test_wedges_are_lists_and_never_rows(spark, near):
    """An oriented edge gives one row with its third corners, also where corners with many ends share them."""
    from meshframe.operators import cliques

    pairs = {(a, b) for a in range(12) for b in range(100, 112)} | {(0, 1), (1, 2), (0, 2), (100, 101)}
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")
    up = cliques.held(edges)
    ends = {r.u: set(r.vs) for r in up.collect()}
    assert sum(map(len, ends.values())) == len(pairs)
    got = cliques.closed(up).collect()
    assert len(got) == len({(r.u, r.v) for r in got}) and all(set(r.ws) <= ends[r.u] & ends[r.v] for r in got)
    assert sum(len(r.ws) for r in got) == cliques.triangles(edges).count() == 1 + 3 * 12 + 12
    assert cliques.four_cliques(edges).count() == 12 + 3


def test_features_join_no_paths_of_two_edges(spark):
    """Third corners at each edge come from the triangles alone."""
    from meshframe.operators import exterior

    tris = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (2, 3, 4)], "a long, b long, c long")
    got = {(r.a, r.b): r.ws for r in exterior.opposite(tris, "ws").collect()}
    assert got == {(1, 2): [3, 4], (1, 3): [2], (2, 3): [1, 4], (1, 4): [2], (2, 4): [1, 3], (3, 4): [2]}
