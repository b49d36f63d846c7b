"""Queries that go from one level of a hierarchy to the next on the order complex, and the SQL that checks them: the
exterior graph, sampling, exterior-first clusters and the interpolation.

The order complex has edges of all lengths; the coarse graph of the interpolation is spanned by those shorter than SHORT,
so that it stays sparse as the tables grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators import cliques, coarsen, exterior, nearest, pde, prolong, sampling, sparse, topology
from meshframe.plans import oracles as S
from meshframe.sources import orders
from meshframe.storage import settle

STEP, SHORT, RADIUS, NEAR = 8, 0.31, 0.3, 0.25


def r6(*names: str) -> list:
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, tetrahedra and edges with lengths."""
    v, t = orders.order_mesh(spark, sf_dir)
    t = settle(t, "tets")
    return v, t, settle(topology.with_length(topology.adjacency(t), v), "edges")


def outside(v: DataFrame, t: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ext = settle(exterior.exterior_vertices(v, t), "exterior")
    return ext, settle(exterior.exterior_edges(v, t, ext, edges), "exterior-edges")


def seeds(v: DataFrame, ext: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """Every ``step``-th part as a sample; exterior if it is among ``ext``."""
    own = v.where(F.col("vid") % step == 0).select(F.floor(F.col("vid") / step).alias("coarse_id"), F.col("vid").alias("fine_vid"))
    if ext is None:
        return own.withColumn("is_exterior", F.lit(False))
    return own.join(ext.select(F.col("vid").alias("fine_vid"), F.lit(True).alias("on")), "fine_vid", "left").select("coarse_id", "fine_vid", F.coalesce("on", F.lit(False)).alias("is_exterior"))


def order_exterior_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exterior.exterior_vertices(*orders.order_mesh(spark, sf_dir)).select("vid", *r6("omega"))


def order_exterior_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside(*mesh(spark, sf_dir))[1]


def order_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sharply the exterior of the order complex bends at its vertices."""
    v, t, edges = mesh(spark, sf_dir)
    ext, ext_edges = outside(v, t, edges)
    return exterior.sharpness(v, ext, ext_edges, edges).select("vid", *r6("feature"))


def order_surface_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = orders.order_mesh(spark, sf_dir)
    return topology.surface_depth(v, topology.boundary_faces(t))


def order_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stiffness of the order complex; its slivers make large entries, so three digits are given."""
    return pde.stiffness(*orders.order_mesh(spark, sf_dir)).select("i", "j", (F.round("v", 3) + 0.0).alias("v"))


def order_poisson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t, _ = mesh(spark, sf_dir)
    return pde.system_matrix("poisson", pde.stiffness(v, t), pde.lumped_mass(v, t)).select("i", "j", (F.round("v", 3) + 0.0).alias("v"))


def order_by_solid_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of the solid angle that their tetrahedra take up, the most exposed first; ties, to six digits, by
    id."""
    sums = exterior.solid_angle_sums(*orders.order_mesh(spark, sf_dir)).select("vid", *r6("omega"))
    return exterior.by_solid_angle(sums).select("vid", F.col("rank").cast("bigint").alias("rank"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t, edges = mesh(spark, sf_dir)
    ext, ext_edges = outside(v, t, edges)
    return exterior.sharpness(v, ext, ext_edges, edges).select("vid", *r6("feature"))


def order_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface's order in sampling: exterior parts, the sharpest first."""
    return exterior.by_feature(features(spark, sf_dir)).select("vid", F.col("rank").cast("bigint").alias("rank"))


def sharpest_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sharpest exterior parts."""
    return exterior.sharpest(features(spark, sf_dir), 10).select("vid", "feature")


def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's neighbours, ascending, as text."""
    lists = topology.neighbour_lists(topology.adjacency(orders.order_tets(spark, sf_dir)))
    return lists.select("vid", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every 40th part to each part."""
    v = orders.order_vertices(spark, sf_dir)
    found = nearest.nearest_centres(v, v.where("vid % 40 = 0").withColumnRenamed("vid", "coarse_id"), 3)
    return found.select("vid", F.col("rank").cast("int").alias("rank"), "coarse_id", *r6("dist"))


def disk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts no two of which are within RADIUS over one or two edges, exterior ones first; all rounds on the cluster."""
    v, t, edges = mesh(spark, sf_dir)
    ext = settle(exterior.exterior_vertices(v, t), "exterior").select("vid", F.col("vid").alias("rank"))
    order = v.select("vid").join(ext, "vid", "left").select("vid", F.coalesce("rank", F.lit(1 << 62)).alias("rank"), F.col("rank").isNotNull().alias("is_exterior"))
    return sampling.disk_sample(order, edges, RADIUS, local=0)[0].select("coarse_id", "fine_vid", "is_exterior")


def exterior_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exterior clustered over its own edges first, then the interior from there and from its seeds. The warm start
    are labels of seeds within NEAR over one or two edges."""
    v, t, edges = mesh(spark, sf_dir)
    ext, ext_edges = outside(v, t, edges)
    samples = settle(seeds(v, ext), "samples")
    both = settle(topology.both_ways(ext_edges).join(edges, ["src", "dst"]).select("src", "dst", "len"), "exterior-both")
    own = samples.select(F.col("fine_vid").alias("src"), "coarse_id")
    near = sampling.reach(edges, NEAR, own).join(own, "src").select(F.col("dst").alias("vid"), "coarse_id", "dist")
    marks = settle(coarsen.nearest(near), "marks")
    made = coarsen.exterior_first(v, samples, marks, ext, both, edges)[0]
    return made.select("vid", "coarse_id", F.when(F.col("dist") < float("inf"), F.round("dist", 6) + 0.0).alias("dist"))


def interpolated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, _, edges = mesh(spark, sf_dir)
    short = settle(edges.where(F.col("len") < SHORT), "short")
    samples = settle(seeds(v), "samples")
    clusters = coarsen.cluster(samples, short)
    coarse = settle(coarsen.quotient(short, clusters), "coarse")
    tris, tets = settle(cliques.triangles(coarse), "cliques3"), settle(cliques.four_cliques(coarse), "cliques4")
    return prolong.interpolation(v, samples, clusters, coarse, tris, tets)


def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights (i, j, v) from every STEP-th part to the parts that short edges reach."""
    return interpolated(spark, sf_dir)[0].select("i", "j", *r6("v"))


def interpolation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the seven cases each part took."""
    return interpolated(spark, sf_dir)[1].select("f", F.col("kind").cast("int").alias("kind"))


def interpolation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the interpolation's worst row sum and least entry, and how many rows and entries are off."""
    p = settle(interpolated(spark, sf_dir)[0], "prolongation")
    unity = sparse.partition_of_unity(p, 1e-4).select(*r6("worst"), "n_off")
    return unity.crossJoin(sparse.negative_entries(p, 1e-4).select("n_negative")).crossJoin(p.agg(F.count_distinct("i").alias("n_rows"), F.count("*").alias("n_entries")))


EXT = [*S.ORDER, S.POINTS, S.UND, S.corner_angles(), S.EXTERIOR, S.edge_angles(), S.EXT_EDGES]
ROUNDS = f"""pair AS MATERIALIZED (SELECT src, dst FROM el WHERE len < {RADIUS} UNION SELECT e.src, f.dst FROM el e JOIN el f ON f.src = e.dst WHERE e.src <> f.dst AND e.len < {RADIUS} AND f.len < {RADIUS} AND e.len + f.len < {RADIUS}),
turn AS (SELECT row_number() OVER (ORDER BY NOT outer_one, vid) AS i, vid, outer_one FROM (SELECT vid, vid IN (SELECT vid FROM ext) AS outer_one FROM pts)),
walk(i, vid, taken) AS (SELECT i, vid, false FROM turn UNION ALL (
WITH undecided AS (SELECT i, vid FROM walk WHERE NOT taken), beaten AS (SELECT DISTINCT p.src AS vid FROM pair p JOIN undecided a ON a.vid = p.src JOIN undecided b ON b.vid = p.dst WHERE b.i < a.i),
won AS (SELECT i, vid FROM undecided WHERE vid NOT IN (SELECT vid FROM beaten)), lost AS (SELECT dst AS vid FROM pair JOIN won ON won.vid = src)
SELECT i, vid, true FROM won UNION ALL SELECT i, vid, false FROM undecided WHERE vid NOT IN (SELECT vid FROM won) AND vid NOT IN (SELECT vid FROM lost)))"""
MARKS = f"""reach AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, len AS dist FROM el UNION ALL SELECT e.src, f.dst, e.len + f.len FROM el e JOIN el f ON f.src = e.dst WHERE e.src <> f.dst AND e.len < {NEAR} AND f.len < {NEAR}) WHERE dist < {NEAR} GROUP BY 1, 2),
seed AS (SELECT vid, vid // {STEP} AS c, vid IN (SELECT vid FROM ext) AS outer_one FROM pts WHERE vid % {STEP} = 0),
mark AS (SELECT dst AS vid, min({{'d': dist, 'c': c}}) AS hit FROM reach JOIN seed ON vid = src GROUP BY 1)"""
SURFACE = """xel AS (SELECT el.* FROM el JOIN (SELECT a AS src, b AS dst FROM xe UNION ALL SELECT b, a FROM xe) USING (src, dst)),
outer_best(vid, dist, c) USING KEY (vid) AS (SELECT vid, 0.0::DOUBLE, c FROM seed WHERE outer_one UNION
SELECT n.vid, n.hit.d, n.hit.c FROM (SELECT e.dst AS vid, min({'d': b.dist + e.len, 'c': b.c}) AS hit FROM outer_best b JOIN xel e ON e.src = b.vid GROUP BY 1) n
LEFT JOIN recurring.outer_best o ON o.vid = n.vid WHERE o.vid IS NULL OR n.hit.d < o.dist OR n.hit.d = o.dist AND n.hit.c < o.c),
surface AS (SELECT vid, coalesce(c, 0) AS c, coalesce(dist, 'inf'::DOUBLE) AS dist FROM ext LEFT JOIN outer_best USING (vid)),
start AS (SELECT vid, hit.d AS dist, hit.c AS c, false AS live FROM mark WHERE vid NOT IN (SELECT vid FROM ext) AND vid NOT IN (SELECT vid FROM seed) UNION ALL SELECT vid, 0.0, c, true FROM seed WHERE NOT outer_one UNION ALL SELECT vid, dist, c, dist < 'inf'::DOUBLE FROM surface),
best(vid, dist, c, live) USING KEY (vid) AS (SELECT * FROM start UNION
SELECT n.vid, n.hit.d, n.hit.c, true FROM (SELECT e.dst AS vid, min({'d': b.dist + e.len, 'c': b.c}) AS hit FROM best b JOIN el e ON e.src = b.vid WHERE b.live AND e.dst NOT IN (SELECT vid FROM ext) GROUP BY 1) n
LEFT JOIN recurring.best o ON o.vid = n.vid WHERE o.vid IS NULL OR n.hit.d < o.dist OR n.hit.d = o.dist AND n.hit.c < o.c)"""


def weights_sql() -> list[str]:
    """The seven cases as ``weights`` (f, kind, j, v)."""
    d3 = lambda p, q: S.norm(S.sub(p, q))
    share = lambda p, a, b: f"CASE WHEN {S.dot(S.sub(b, a), S.sub(b, a))} > 1e-20 THEN greatest(0.0, least(1.0, {S.dot(S.sub(p, a), S.sub(b, a))} / {S.dot(S.sub(b, a), S.sub(b, a))})) ELSE 0.0 END"
    away = lambda p, a, b: "sqrt(" + " + ".join(f"pow({p}{x} - {a}{x} - ({b}{x} - {a}{x}) * ({share(p, a, b)}), 2)" for x in "xyz") + ")"
    at = lambda k, alias: ", ".join(f"{alias}.{x} AS {k}{x}" for x in "xyz")
    turned = lambda n, names: " UNION ALL ".join(f"SELECT {', '.join(f'{names[(s + i) % n]} AS r{i}' for i in range(n))}, {', '.join(f'{k} AS o{k}' for k in names)} FROM {'clique4' if n == 4 else 'clique3'}" for s in range(n))
    e, r = [S.sub(f"q{i}", "q0") for i in (1, 2, 3)], S.sub("p", "q0")
    n = [S.cross(e[1], e[2]), S.cross(e[2], e[0]), S.cross(e[0], e[1])]
    whole, flat = S.dot(e[0], n[0]), "least(" + ", ".join(S.dot(x, x) for x in n) + ") < 1e-20"
    s, t = S.sub("q1", "q0"), S.sub("q2", "q0")
    box = " AND ".join(f"p{x} >= least(q0{x}, q1{x}, q2{x}, q3{x}) - 1e-4 AND p{x} <= greatest(q0{x}, q1{x}, q2{x}, q3{x}) + 1e-4" for x in "xyz")
    corners = lambda k: " ".join(f"JOIN place q{i} ON q{i}.id = r{i}" for i in range(k))
    spots = lambda k: ", ".join(at(f"q{i}", f"q{i}") for i in range(k))
    edge = lambda rows, kind: f"SELECT f, {kind} AS kind, unnest([c, \"to\"]) AS j, unnest([1 - w, w]) AS v FROM (SELECT f, c, \"to\", {share('p', 'q0', 'q1')} AS w FROM (SELECT m.f, m.c, m.\"to\", px, py, pz, {at('q0', 'q0')}, {at('q1', 'q1')} FROM {rows} m JOIN place q0 ON q0.id = m.c JOIN place q1 ON q1.id = m.\"to\"))"
    return [
        f"short AS MATERIALIZED (SELECT * FROM el WHERE len < {SHORT})",
        f"seed AS (SELECT vid FROM pts WHERE vid % {STEP} = 0)",
        S.SHORTEST.replace("vid // 40", f"vid // {STEP}").replace("JOIN el e", "JOIN short e"),
        f"place AS (SELECT vid // {STEP} AS id, x, y, z FROM pts JOIN seed USING (vid))",
        "coarse AS MATERIALIZED (SELECT DISTINCT a.coarse_id AS src, b.coarse_id AS dst FROM short JOIN best a ON a.vid = src JOIN best b ON b.vid = dst WHERE a.coarse_id <> b.coarse_id)",
        "clique3 AS MATERIALIZED (SELECT e.src AS a, e.dst AS b, f.dst AS c FROM coarse e JOIN coarse f ON f.src = e.dst AND f.dst > f.src JOIN coarse h ON h.src = e.src AND h.dst = f.dst WHERE e.src < e.dst)",
        "clique4 AS MATERIALIZED (SELECT a, b, c, x.dst AS d FROM clique3 JOIN coarse x ON x.src = c AND x.dst > c JOIN coarse y ON y.src = a AND y.dst = x.dst JOIN coarse z ON z.src = b AND z.dst = x.dst)",
        "deg AS (SELECT src AS c, count(*) AS n, min(dst) AS one FROM coarse GROUP BY 1)",
        f"fine AS MATERIALIZED (SELECT vid AS f, coarse_id AS c, x AS px, y AS py, z AS pz, vid IN (SELECT vid FROM seed) AS own, n, one AS \"to\" FROM best JOIN pts USING (vid) LEFT JOIN deg ON deg.c = coarse_id)",
        "rest3 AS MATERIALIZED (SELECT * FROM fine WHERE NOT own AND n > 1)",
        f"met4 AS (SELECT f, r0, r1, r2, r3, oa, ob, oc, od, px, py, pz, {spots(4)} FROM rest3 JOIN ({turned(4, 'abcd')}) ON r0 = c {corners(4)})",
        f"in4 AS (SELECT *, {flat} OR {whole} = 0 AS flat, {', '.join(f'{S.dot(r, x)} / {whole} AS w{i + 1}' for i, x in enumerate(n))} FROM met4 WHERE {box})",
        "scored4 AS (SELECT *, 1 - w1 - w2 - w3 AS w0, CASE WHEN flat OR least(1 - w1 - w2 - w3, w1, w2, w3) < 0 THEN -1.0 ELSE least(1 - w1 - w2 - w3, w1, w2, w3) END AS metric FROM in4)",
        "found3 AS MATERIALIZED (SELECT * FROM scored4 WHERE metric > -1e-5 QUALIFY row_number() OVER (PARTITION BY f ORDER BY metric, oa, ob, oc, od) = 1)",
        "rest4 AS MATERIALIZED (SELECT * FROM rest3 WHERE f NOT IN (SELECT f FROM found3))",
        f"met3 AS (SELECT f, c, r0, r1, r2, oa, ob, oc, px, py, pz, {spots(3)} FROM rest4 JOIN ({turned(3, 'abc').replace('SELECT ', 'SELECT ')}) k ON r0 = rest4.c {corners(3)})",
        f"raw3 AS (SELECT *, {S.dot(s, s)} AS ss, {S.dot(s, t)} AS st, {S.dot(t, t)} AS tt, {S.dot(S.sub('p', 'q0'), s)} AS rs, {S.dot(S.sub('p', 'q0'), t)} AS rt, abs({S.dot(S.cross(s, t), S.sub('p', 'q0'))}) / {S.norm(S.cross(s, t))} AS h FROM met3)",
        "tried AS MATERIALIZED (SELECT *, abs(ss * tt - st * st) < 1e-12 AS flat, (tt * rs - st * rt) / (ss * tt - st * st) AS w1, (ss * rt - st * rs) / (ss * tt - st * st) AS w2 FROM raw3)",
        "found4 AS MATERIALIZED (SELECT *, 1 - w1 - w2 AS w0 FROM tried WHERE NOT flat AND least(1 - w1 - w2, w1, w2) >= -1e-5 QUALIFY row_number() OVER (PARTITION BY f ORDER BY h, oa, ob, oc) = 1)",
        f"""sides AS (SELECT f, c, px, py, pz, oa, ob, oc, unnest([r2, r0, r1]) AS "to", unnest([{away('p', 'q0', 'q1')}, {away('p', 'q1', 'q2')}, {away('p', 'q2', 'q0')}]) AS away FROM tried WHERE NOT flat AND least(1 - w1 - w2, w1, w2) < -1e-5 AND f NOT IN (SELECT f FROM found4))""",
        """last5 AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY f, "to" ORDER BY oa DESC, ob DESC, oc DESC) = 1)""",
        """found5 AS MATERIALIZED (SELECT * FROM last5 QUALIFY row_number() OVER (PARTITION BY f ORDER BY away, "to") = 1)""",
        "rest6 AS (SELECT f, c, px, py, pz FROM rest4 WHERE f NOT IN (SELECT f FROM found4) AND f NOT IN (SELECT f FROM found5))",
        f"""near6 AS (SELECT f, dst AS "to", {d3('p', 'q.')} AS d, row_number() OVER (PARTITION BY f ORDER BY {d3('p', 'q.')}, dst) AS r FROM rest6 JOIN coarse ON src = c JOIN place q ON q.id = dst),
all6 AS (SELECT f, "to", d, r FROM near6 WHERE r <= 3 UNION ALL SELECT f, c, {d3('p', 'q.')}, 0 FROM rest6 JOIN place q ON q.id = c),
hit6 AS (SELECT f, min(r) FILTER (d < 1e-12) AS h, sum(1 / d) FILTER (d >= 1e-12) AS total FROM all6 GROUP BY 1)""",
        f"""weights AS MATERIALIZED (SELECT f, 0 AS kind, f // {STEP} AS j, 1.0::DOUBLE AS v FROM fine WHERE own UNION ALL SELECT f, 1, c, 1.0 FROM fine WHERE NOT own AND n IS NULL
UNION ALL {edge('(SELECT * FROM fine WHERE NOT own AND n = 1)', 2)}
UNION ALL SELECT * FROM (SELECT f, 3, unnest([r0, r1, r2, r3]) AS j, unnest([w0, w1, w2, w3]) AS v FROM found3) WHERE v > 1e-12
UNION ALL SELECT * FROM (SELECT f, 4, unnest([r0, r1, r2]) AS j, unnest([w0, w1, w2]) AS v FROM found4) WHERE v > 1e-12
UNION ALL {edge('found5', 5)}
UNION ALL SELECT * FROM (SELECT f, 6, "to" AS j, CASE WHEN h IS NOT NULL THEN CASE WHEN h = r THEN 1.0 ELSE 0.0 END ELSE 1 / d / total END AS v FROM all6 JOIN hit6 USING (f)) WHERE v > 1e-12)""",
    ]


WEIGHTS = f"WITH RECURSIVE {', '.join([S.PARTS, S.TETS, S.UND, S.LENGTHS, *weights_sql()])}\n"
QUERIES = {f.__name__: f for f in (order_exterior_vertices, order_exterior_edges, order_sharpness, order_surface_depth, order_stiffness, order_poisson_matrix, order_by_solid_angle, order_by_feature, sharpest_vertices, neighbour_lists, nearest_three, disk_sample, exterior_clusters, interpolation, interpolation_cases, interpolation_checks)}
ORACLES = {
    "order_exterior_vertices": S.sql([*S.ORDER, S.POINTS, S.corner_angles(), S.EXTERIOR], f"SELECT vid, {S.r6('omega')} AS omega FROM ext"),
    "order_exterior_edges": S.sql(EXT, "SELECT a, b FROM xe"),
    "order_sharpness": S.sql([*EXT, S.SURFACE], f"SELECT vid, {S.r6('feature')} AS feature FROM feature"),
    "order_surface_depth": S.sql([*S.ORDER, S.FACES], "SELECT vid, CASE WHEN vid IN (SELECT unnest([a, b, c]) FROM bfaces) THEN 0 ELSE 1 END AS depth FROM pts"),
    "order_stiffness": S.sql([*S.ORDER, S.POINTS, S.stiffness()], "SELECT i, j, round(v, 3) + 0.0 AS v FROM stiff"),
    "order_poisson_matrix": S.sql([*S.ORDER, S.POINTS, S.stiffness(), S.MASS], "SELECT i, j, round(sum(v), 3) + 0.0 AS v FROM (SELECT * FROM stiff UNION ALL SELECT i, i, 1e-3 * v FROM mass) GROUP BY 1, 2"),
    "order_by_solid_angle": S.sql([*S.ORDER, S.POINTS, S.corner_angles()], "SELECT vid, row_number() OVER (ORDER BY round(omega, 6), vid) - 1 AS rank FROM omega"),
    "order_by_feature": S.sql([*EXT, S.SURFACE], "SELECT vid, row_number() OVER (ORDER BY round(feature, 6) DESC, vid) - 1 AS rank FROM feature"),
    "sharpest_vertices": S.sql([*EXT, S.SURFACE], f"SELECT vid, {S.r6('feature')} AS feature FROM feature ORDER BY round(feature, 6) DESC, vid LIMIT 10"),
    "neighbour_lists": S.sql(S.GRAPH, "SELECT src AS vid, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM adj GROUP BY 1"),
    "nearest_three": S.sql([S.PARTS], f"SELECT vid, rank::INTEGER AS rank, coarse_id, {S.r6('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY dist, coarse_id) AS rank FROM (SELECT p.vid, q.vid AS coarse_id, {S.norm(S.sub('p.', 'q.'))} AS dist FROM pts p, pts q WHERE q.vid % 40 = 0)) WHERE rank <= 3"),
    "interpolation_checks": WEIGHTS + f", p AS (SELECT f, j, sum(v) AS v FROM weights GROUP BY 1, 2), sums AS (SELECT f, abs(sum(v) - 1) AS off FROM p GROUP BY 1) SELECT {S.r6('max(off)')} AS worst, count(*) FILTER (off > 1e-4) AS n_off, (SELECT count(*) FILTER (v < -1e-4) FROM p) AS n_negative, count(*) AS n_rows, (SELECT count(*) FROM p) AS n_entries FROM sums",
    "disk_sample": f"WITH RECURSIVE {', '.join([*S.ORDER, S.POINTS, S.UND, S.corner_angles(), S.EXTERIOR, S.LENGTHS, ROUNDS])}\nSELECT row_number() OVER (ORDER BY t.i) - 1 AS coarse_id, vid AS fine_vid, outer_one AS is_exterior FROM walk JOIN turn t USING (vid) WHERE taken",
    "exterior_clusters": f"WITH RECURSIVE {', '.join([*EXT, S.LENGTHS, MARKS, SURFACE])}\nSELECT vid, coalesce(c, 0) AS coarse_id, CASE WHEN dist < 'inf'::DOUBLE THEN {S.r6('dist')} END AS dist FROM pts LEFT JOIN best USING (vid)",
    "interpolation": WEIGHTS + f"SELECT f AS i, j, {S.r6('sum(v)')} AS v FROM weights GROUP BY 1, 2",
    "interpolation_cases": WEIGHTS + "SELECT DISTINCT f, kind::INTEGER AS kind FROM weights",
}
