"""The jobs as queries: each runs its job twice into one new folder of the shared ones and returns what stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import mesh_audit, word_graph
from meshframe.plans import oracles as S
from meshframe.storage import shared_folder


def r6(name: str):
    return (F.round(name, 6) + 0.0).alias(name)


def job1_mesh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_folder(spark)}/mesh-audit-{uuid.uuid4().hex}"
    for _ in range(2):
        made = mesh_audit.run(spark, sf_dir, output)
    return made.select("month", "tid", *[f"v{i}" for i in range(4)], r6("volume"), r6("shortest"), r6("longest"), r6("quality"), "is_flat", "n_boundary", "n_crowded")


def job2_word_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_folder(spark)}/word-graph-{uuid.uuid4().hex}"
    for _ in range(2):
        made = word_graph.run(spark, sf_dir, output)
    return made.select("a", "b", "n", r6("v"))


EDGES = [S.norm(S.sub(f"p{i}", f"p{j}")) for i in range(4) for j in range(i + 1, 4)]
AUDIT = S.sql(
    [*S.ORDER, S.POINTS, S.FACES, "dated AS (SELECT o_orderkey AS tid, coalesce(strftime(o_orderdate, '%Y-%m'), 'none') AS month FROM orders)",
     f"sized AS (SELECT tid, v0, v1, v2, v3, abs({S.volume6('p0', 'p1', 'p2', 'p3')}) / 6 AS volume, least({', '.join(EDGES)}) AS shortest, greatest({', '.join(EDGES)}) AS longest FROM tp)",
     "counted AS (SELECT k.tid, month, count(*) OVER (PARTITION BY month, a, b, c) AS n FROM keyed k JOIN dated USING (tid))",
     "around AS (SELECT month, tid, count(*) FILTER (n = 1) AS n_boundary, count(*) FILTER (n > 2) AS n_crowded FROM counted GROUP BY 1, 2)"],
    f"SELECT month, tid, v0, v1, v2, v3, {S.r6('volume')} AS volume, {S.r6('shortest')} AS shortest, {S.r6('longest')} AS longest, {S.r6('CASE WHEN longest > 0 THEN 6 * sqrt(2.0) * volume / pow(longest, 3) ELSE 0 END')} AS quality, volume < 1e-12 AS is_flat, n_boundary, n_crowded FROM sized JOIN around USING (tid)",
)
WORDS = S.sql(
    ["words AS (SELECT list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)",
     "beside AS (SELECT unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM words WHERE len(w) > 1)",
     "counts AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM beside WHERE x <> y GROUP BY 1, 2)",
     "sums AS (SELECT w, sum(n)::DOUBLE AS s FROM (SELECT a AS w, n FROM counts UNION ALL SELECT b, n FROM counts) GROUP BY 1)"],
    f"SELECT a, b, n, {S.r6('n / (sqrt(p.s) * sqrt(q.s))')} AS v FROM counts JOIN sums p ON p.w = a JOIN sums q ON q.w = b",
)
QUERIES = {f.__name__: f for f in (job1_mesh_audit, job2_word_graph)}
ORACLES = {"job1_mesh_audit": AUDIT, "job2_word_graph": WORDS}
