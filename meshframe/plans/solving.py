"""Queries that solve, and the SQL that checks them: V-cycles over tables and sparse factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators import factor, sparse, spectral, topology
from meshframe.plans import oracles as S
from meshframe.plans.cycle import TableCycle
from meshframe.sources import orders
from meshframe.storage import settle

CYCLES, RATIO, LEVELS = 2, 40, 3
WIDTH = 40


def r6(name: str):
    return (F.round(name, 6) + 0.0).alias(name)


def ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.order_vertices(spark, sf_dir).select(F.col("vid").alias("i"), (F.col("vid") % 17).cast("double").alias("v"))


def graph_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order complex's graph Laplacian with 1 added on the diagonal."""
    edges = settle(topology.adjacency(orders.order_tets(spark, sf_dir)), "edges")
    off = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("v"))
    return settle(off.unionByName(topology.vertex_degree(edges).select(F.col("vid").alias("i"), F.col("vid").alias("j"), (F.col("degree") + 1.0).alias("v"))), "matrix")


def grouped(rows: DataFrame) -> DataFrame:
    """Interpolation from groups of RATIO neighbouring ids, weight 1."""
    return rows.select("i", F.floor(F.col("i") / RATIO).alias("j"), F.lit(1.0).alias("v"))


def poisson_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CYCLES V-cycles over LEVELS levels from zero, on the order complex; the right side is that of the ramp."""
    a, x = graph_matrix(spark, sf_dir), ramp(spark, sf_dir)
    rows = settle(sparse.diagonal(a).select("i"), "rows")
    steps, level = [], rows
    for _ in range(LEVELS - 1):
        steps.append(settle(grouped(level), "groups"))
        level = steps[-1].select(F.col("j").alias("i")).distinct()
    places = level.select("i", F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    solver = TableCycle(a, rows, steps, places, bound=True)
    return solver.solve(sparse.spmv(a, x), max_cycles=CYCLES, tolerance=0.0)[0].select("i", r6("v"))


def plate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(matrix, places): parts on a plate of WIDTH columns, neighbours joined by springs whose stiffness follows their
    sizes, each part held by a spring of stiffness 1."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("i"), "p_size")
    places = part.select("i", (F.col("i") % WIDTH).cast("double").alias("x"), F.floor(F.col("i") / WIDTH).cast("double").alias("y"), F.lit(0.0).alias("z"))
    ahead = F.array(*[F.when(F.col("i") % WIDTH < WIDTH - 1, F.col("i") + 1), F.col("i") + WIDTH])
    pairs = part.select("i", "p_size", F.explode(ahead).alias("j")).join(factor.apart(part.select(F.col("i").alias("j"), F.col("p_size").alias("other"))), "j")
    springs = settle(pairs.select("i", "j", (1 + (F.col("p_size") + F.col("other")) / 100.0).alias("k")), "springs")
    each = F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (s * F.col("k")).alias("v")) for p, q, s in (("i", "j", -1.0), ("j", "i", -1.0), ("i", "i", 1.0), ("j", "j", 1.0))])
    held = places.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return settle(sparse.reduce_entries(springs.select(F.inline(each)).unionByName(held)), "plate"), places


def factor_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plate solved by sparse factors for the right side whose solution is the ramp."""
    a, places = plate(spark, sf_dir)
    return factor.solve(factor.factorise(a, places), sparse.spmv(a, factor.apart(ramp(spark, sf_dir)))).select("i", r6("v"))


def largest_eigenvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plate's D^-1 A by 50 Lanczos steps, with the safety factor; and the bound by rows."""
    a, places = plate(spark, sf_dir)
    return spark.createDataFrame([(spectral.largest_eigenvalue(a, places.select("i")), spectral.row_bound(a))], "estimate double, bound double").select(r6("estimate"), r6("bound"))


def cycle_sql() -> str:
    """The cycles unrolled: x<n> are vectors (i, v), b<n> right sides."""
    parts, made = [S.TETS, S.UND, S.LAP, S.RAMP, S.RHS, "a0 AS MATERIALIZED (SELECT i, j, v FROM lap)"], iter(range(10_000))
    add = lambda name, body: parts.append(f"{name} AS MATERIALIZED ({body})") or name
    for k in range(1, LEVELS):
        add(f"a{k}", f"SELECT i // {RATIO} AS i, j // {RATIO} AS j, sum(v) AS v FROM a{k - 1} GROUP BY 1, 2")
    for k in range(LEVELS):
        add(f"d{k}", f"SELECT i, 1 / v AS v FROM a{k} WHERE i = j")
        weights = ", ".join(f"2 / (m + m / 10 - (m - m / 10) * cos({S.PI} * {2 * s + 1} / 4)) AS w{s}" for s in range(2))
        add(f"w{k}", f"SELECT {weights} FROM (SELECT max(s) AS m FROM (SELECT sum(abs(v)) / sum(abs(v)) FILTER (i = j) AS s FROM a{k} GROUP BY i))")
    last = LEVELS - 1
    add("place", f"SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM d{last}")
    add("wide", f"SELECT p.k AS r, q.k AS c, coalesce(v, 0.0) AS v FROM place p CROSS JOIN place q LEFT JOIN a{last} a ON a.i = p.i AND a.j = q.i UNION ALL SELECT p.k, q.k + (SELECT count(*) FROM place), CASE WHEN p.k = q.k THEN 1.0 ELSE 0.0 END FROM place p CROSS JOIN place q")
    parts.append("""turned(step, r, c, v) AS (SELECT 0, r, c, v FROM wide UNION ALL SELECT g.step + 1, g.r, g.c, CASE WHEN g.r = g.step THEN g.v / p.v ELSE g.v - f.v * t.v / p.v END
FROM turned g JOIN turned p ON p.r = g.step AND p.c = g.step JOIN turned f ON f.r = g.r AND f.c = g.step JOIN turned t ON t.r = g.step AND t.c = g.c WHERE g.step < (SELECT count(*) FROM place))""")
    add("inverse", "SELECT p.i, q.i AS j, v FROM turned JOIN place p ON p.k = r JOIN place q ON q.k = c - (SELECT count(*) FROM place) WHERE step = (SELECT count(*) FROM place)")
    product = lambda k, x: f"(SELECT l.i, sum(l.v * y.v) AS v FROM a{k} l JOIN {x} y ON y.i = l.j GROUP BY 1)"

    def swept(k: int, x: str | None, b: str, s: int) -> str:
        if x is None:
            return add(f"x_{next(made)}", f"SELECT d.i, w.w{s} * d.v * coalesce(b.v, 0) AS v FROM d{k} d LEFT JOIN {b} b USING (i), w{k} w")
        return add(f"x_{next(made)}", f"SELECT d.i, x.v + w.w{s} * d.v * (coalesce(b.v, 0) - coalesce(ax.v, 0)) AS v FROM d{k} d JOIN {x} x USING (i) LEFT JOIN {b} b USING (i) LEFT JOIN {product(k, x)} ax USING (i), w{k} w")

    def cycle(k: int, x: str | None, b: str) -> str:
        if k == last:
            return add(f"x_{next(made)}", f"SELECT l.i, sum(l.v * b.v) AS v FROM inverse l JOIN {b} b ON b.i = l.j GROUP BY 1")
        for s in range(2):
            x = swept(k, x, b, s)
        low = add(f"b_{next(made)}", f"SELECT d.i // {RATIO} AS i, sum(coalesce(b.v, 0) - coalesce(ax.v, 0)) AS v FROM d{k} d LEFT JOIN {b} b USING (i) LEFT JOIN {product(k, x)} ax USING (i) GROUP BY 1")
        step = cycle(k + 1, None, low)
        x = add(f"x_{next(made)}", f"SELECT x.i, x.v + c.v AS v FROM {x} x JOIN {step} c ON c.i = x.i // {RATIO}")
        for s in range(2):
            x = swept(k, x, b, s)
        return x

    x = add("x_start", "SELECT i, 0.0::DOUBLE AS v FROM d0")
    for _ in range(CYCLES):
        x = cycle(0, x, "rhs")
    return f"WITH RECURSIVE {', '.join(parts)}\nSELECT i, {S.r6('v')} AS v FROM {x}"


QUERIES = {f.__name__: f for f in (poisson_solution, factor_solution, largest_eigenvalue)}
#: The plate's right side is made from its solution, so that SQL has it without solving; a test holds the estimate.
ORACLES = {"poisson_solution": cycle_sql(), "factor_solution": f"WITH {S.RAMP} SELECT i, v FROM ramp"}
