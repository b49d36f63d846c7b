"""DuckDB SQL for the mesh queries, built from shared common table expressions.

Geometry is spelled out by small helpers over column prefixes: a point ``p`` is the columns px, py and pz."""

from __future__ import annotations

PARTS = """pts AS (SELECT p_partkey AS vid, ((p_partkey * 7919) % 1009)::DOUBLE / 1009 AS x, ((p_partkey * 104729) % 2003)::DOUBLE / 2003 AS y, p_size::DOUBLE / 50 AS z FROM part)"""
TETS = """ranked AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
tets AS (SELECT l_orderkey AS tid, max(CASE r WHEN 1 THEN l_partkey END) AS v0, max(CASE r WHEN 2 THEN l_partkey END) AS v1, max(CASE r WHEN 3 THEN l_partkey END) AS v2, max(CASE r WHEN 4 THEN l_partkey END) AS v3 FROM ranked WHERE r <= 4 GROUP BY 1 HAVING count(*) = 4)"""
UND = """und AS (SELECT DISTINCT * FROM (""" + " UNION ALL ".join(f"SELECT least(v{i}, v{j}) AS a, greatest(v{i}, v{j}) AS b FROM tets" for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))) + """)),
adj AS (SELECT a AS src, b AS dst FROM und UNION ALL SELECT b, a FROM und)"""
FACES = """faces AS (""" + " UNION ALL ".join(f"SELECT tid, v{f[0]} AS f0, v{f[1]} AS f1, v{f[2]} AS f2 FROM tets" for f in ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))) + """),
keyed AS (SELECT *, least(f0, f1, f2) AS a, f0 + f1 + f2 - least(f0, f1, f2) - greatest(f0, f1, f2) AS b, greatest(f0, f1, f2) AS c FROM faces),
bfaces AS (SELECT * FROM keyed QUALIFY count(*) OVER (PARTITION BY a, b, c) = 1)"""
POINTS = """tp AS (SELECT t.*, """ + ", ".join(f"p{i}.{a} AS p{i}{a}" for i in range(4) for a in "xyz") + " FROM tets t " + " ".join(f"JOIN pts p{i} ON p{i}.vid = t.v{i}" for i in range(4)) + ")"
LAP = """lap AS (SELECT src AS i, dst AS j, -1.0::DOUBLE AS v FROM adj UNION ALL SELECT src, src, count(*) + 1.0::DOUBLE FROM adj GROUP BY 1)"""
RAMP = "ramp AS (SELECT p_partkey AS i, (p_partkey % 17)::DOUBLE AS v FROM part)"
GROUPS = "lab AS (SELECT p_partkey AS vid, p_partkey // 40 AS c FROM part)"
RHS = "rhs AS (SELECT l.i, sum(l.v * x.v) AS v FROM lap l JOIN ramp x ON x.i = l.j GROUP BY 1)"
ORDER = [PARTS, TETS]
GRAPH = [TETS, UND]


def cube(n: int) -> str:
    m = n - 1
    corners = ((0, 1, 3, 7), (0, 5, 1, 7), (0, 4, 5, 7), (0, 6, 4, 7), (0, 2, 6, 7), (0, 3, 2, 7))
    at = lambda k: f"base + {(k & 1) + (k >> 1 & 1) * n + (k >> 2) * n * n}"
    tets = " UNION ALL ".join(f"SELECT cell * 6 + {t} AS tid, {', '.join(f'{at(k)} AS v{i}' for i, k in enumerate(c))} FROM cells" for t, c in enumerate(corners))
    return f"""pts AS (SELECT id AS vid, (id % {n}) * (1.0::DOUBLE / {m}) AS x, ((id // {n}) % {n}) * (1.0::DOUBLE / {m}) AS y, (id // {n * n}) * (1.0::DOUBLE / {m}) AS z FROM range({n**3}) r(id)),
cells AS (SELECT id AS cell, id % {m} + (id // {m}) % {m} * {n} + (id // {m * m}) * {n * n} AS base FROM range({m**3}) r(id)),
tets AS ({tets})"""


def sql(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def sub(p: str, q: str) -> tuple[str, str, str]:
    return tuple(f"({p}{a} - {q}{a})" for a in "xyz")  # type: ignore[return-value]


def dot(u, v) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def cross(u, v):
    return (f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})")


def norm(u) -> str:
    return f"sqrt({dot(u, u)})"


def volume6(a: str, b: str, c: str, d: str) -> str:
    return dot(sub(b, a), cross(sub(c, a), sub(d, a)))


def solid(o: str, p: str, q: str, r: str) -> str:
    a, b, c = sub(p, o), sub(q, o), sub(r, o)
    la, lb, lc = norm(a), norm(b), norm(c)
    below = f"{la} * {lb} * {lc} + {la} * {dot(b, c)} + {lb} * {dot(a, c)} + {lc} * {dot(a, b)}"
    return f"CASE WHEN least({la}, {lb}, {lc}) < 1e-14 THEN 0.0 ELSE abs(2 * atan2({dot(a, cross(b, c))}, {below})) END"


def dihedral(a: str, b: str, p: str, q: str) -> str:
    e = sub(b, a)
    u, w = cross(e, sub(p, a)), cross(e, sub(q, a))
    return f"CASE WHEN {norm(e)} < 1e-14 OR least({norm(u)}, {norm(w)}) < 1e-14 * {norm(e)} THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, {dot(u, w)} / ({norm(u)} * {norm(w)})))) END"


def corner_angles() -> str:
    rows = " UNION ALL ".join(f"SELECT v{i} AS vid, {solid(f'p{i}', *[f'p{j}' for j in range(4) if j != i])} AS omega FROM tp" for i in range(4))
    return f"omega AS (SELECT vid, sum(omega) AS omega FROM ({rows}) GROUP BY 1)"


def edge_angles() -> str:
    rows = []
    for i in range(4):
        for j in range(i + 1, 4):
            k, m = (x for x in range(4) if x not in (i, j))
            rows.append(f"SELECT least(v{i}, v{j}) AS a, greatest(v{i}, v{j}) AS b, {dihedral(f'p{i}', f'p{j}', f'p{k}', f'p{m}')} AS theta FROM tp")
    return f"theta AS (SELECT a, b, sum(theta) AS theta FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2)"


PI = "3.141592653589793::DOUBLE"
EXTERIOR = f"ext AS (SELECT vid, coalesce(omega, 0.0) AS omega FROM pts LEFT JOIN omega USING (vid) WHERE coalesce(omega, 0.0) < 0.99 * 4 * {PI})"
EXT_EDGES = f"xe AS (SELECT a, b FROM theta WHERE theta < 0.99 * 2 * {PI} AND a IN (SELECT vid FROM ext) AND b IN (SELECT vid FROM ext))"
SURFACE = """xb AS (SELECT a AS src, b AS dst FROM xe UNION ALL SELECT b, a FROM xe),
shared AS (SELECT a, b, w, row_number() OVER (PARTITION BY a, b ORDER BY w) AS r, count(*) OVER (PARTITION BY a, b) AS n FROM (SELECT xe.a, xe.b, p.dst AS w FROM xe JOIN xb p ON p.src = xe.a JOIN xb q ON q.src = xe.b AND q.dst = p.dst)),
side AS (SELECT s.a, s.b, s.r, s.w, (SELECT min(k1.dst) FROM adj k1, adj k2, adj k3 WHERE k1.src = s.a AND k2.src = s.b AND k3.src = s.w AND k1.dst = k2.dst AND k2.dst = k3.dst) AS k FROM shared s WHERE r <= 2 AND n >= 2),
located AS (SELECT s.a, s.b, s.r, """ + ", ".join(f"p{n}.{c} AS p{n}{c}" for n in "abwk" for c in "xyz") + """ FROM side s JOIN pts pa ON pa.vid = s.a JOIN pts pb ON pb.vid = s.b JOIN pts pw ON pw.vid = s.w LEFT JOIN pts pk ON pk.vid = s.k),
raw AS (SELECT a, b, r, """ + ", ".join(f"{x} AS n{c}" for c, x in zip("xyz", cross(sub("pb", "pa"), sub("pw", "pa")), strict=True)) + ", " + ", ".join(f"{x} AS i{c}" for c, x in zip("xyz", sub("pk", "pa"), strict=True)) + """ FROM located),
unit AS (SELECT a, b, r, sqrt(nx * nx + ny * ny + nz * nz) AS size, CASE WHEN nx * ix + ny * iy + nz * iz > 0 THEN -1.0 ELSE 1.0 END / sqrt(nx * nx + ny * ny + nz * nz) AS s, nx, ny, nz FROM raw),
bent AS (SELECT u.a, u.b, acos(greatest(-1.0, least(1.0, u.s * w.s * (u.nx * w.nx + u.ny * w.ny + u.nz * w.nz)))) AS angle FROM unit u JOIN unit w ON u.a = w.a AND u.b = w.b AND u.r = 1 AND w.r = 2 WHERE u.size >= 1e-14 AND w.size >= 1e-14),
feature AS (SELECT vid, coalesce(f, 0.0) AS feature FROM ext LEFT JOIN (SELECT vid, sum(angle) AS f FROM (SELECT a AS vid, angle FROM bent UNION ALL SELECT b, angle FROM bent) GROUP BY 1) USING (vid))"""
CUBE_X = [POINTS, UND, corner_angles(), EXTERIOR, edge_angles(), EXT_EDGES]
MASS = "mass AS (SELECT i, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT v{i} AS i, abs({volume6('p0', 'p1', 'p2', 'p3')}) / 24 AS v FROM tp" for i in range(4)) + ") GROUP BY 1)"


def stiffness() -> str:
    faces = [cross(sub("p3", "p1"), sub("p2", "p1")), cross(sub("p2", "p0"), sub("p3", "p0")), cross(sub("p3", "p0"), sub("p1", "p0")), cross(sub("p1", "p0"), sub("p2", "p0"))]
    grads = ", ".join(f"{x} / {volume6('p0', 'p1', 'p2', 'p3')} AS g{i}{c}" for i, f in enumerate(faces) for c, x in zip("xyz", f, strict=True))
    rows = " UNION ALL ".join(f"SELECT v{i} AS i, v{j} AS j, vol * (g{i}x * g{j}x + g{i}y * g{j}y + g{i}z * g{j}z) AS v FROM grad" for i in range(4) for j in range(4))
    return f"grad AS (SELECT v0, v1, v2, v3, abs({volume6('p0', 'p1', 'p2', 'p3')}) / 6 AS vol, {grads} FROM tp), stiff AS (SELECT i, j, sum(v) AS v FROM ({rows}) GROUP BY 1, 2)"


WHOLE = [TETS, UND, "g AS (SELECT a, b FROM und)"]
LINEAR = [TETS, UND, LAP, RAMP, RHS]
BRANDS = "p AS (SELECT p_partkey AS i, p_partkey // 40 AS j, 1.0::DOUBLE AS v FROM part)"
LENGTHS = f"el AS (SELECT src, dst, {norm(sub('p.', 'q.'))} AS len FROM adj JOIN pts p ON p.vid = src JOIN pts q ON q.vid = dst)"
SEEDS = "seed AS (SELECT p_partkey AS vid FROM part WHERE p_partkey % 40 = 0)"
SPOTS = "spot AS (SELECT vid, x AS qx, y AS qy, z AS qz, vid // 40 AS g FROM pts), corner AS (SELECT *, v0 // 40 AS g FROM tp)"

#: Labelled shortest paths from the seeds: rows of one key replace each other until none gets better.
SHORTEST = """best(vid, dist, coarse_id) USING KEY (vid) AS (SELECT vid, 0.0::DOUBLE, vid // 40 FROM seed UNION
SELECT n.vid, n.hit.d, n.hit.c FROM (SELECT e.dst AS vid, min({'d': b.dist + e.len, 'c': b.coarse_id}) AS hit FROM best b JOIN el e ON e.src = b.vid GROUP BY 1) n
LEFT JOIN recurring.best o ON o.vid = n.vid WHERE o.vid IS NULL OR n.hit.d < o.dist OR n.hit.d = o.dist AND n.hit.c < o.coarse_id)"""
#: Going through a cube's vertices in order, exterior ones first: a vertex not yet seen is taken, and all that it reaches are seen.
WALK = f"""el AS (SELECT src, dst, {norm(sub('p.', 'q.'))} AS len FROM adj JOIN pts p ON p.vid = src JOIN pts q ON q.vid = dst),
radius AS (SELECT pow(2.0, 1.0 / 3) * avg(len) AS r FROM el WHERE src < dst AND len > 0),
pair AS (SELECT src, dst FROM el, radius WHERE len < r UNION SELECT e.src, f.dst FROM el e JOIN el f ON f.src = e.dst, radius WHERE e.src <> f.dst AND e.len < r AND f.len < r AND e.len + f.len < r),
around AS (SELECT src, list(dst) AS ds FROM pair GROUP BY 1),
turn AS (SELECT row_number() OVER (ORDER BY NOT outer_one, vid) AS i, vid, outer_one FROM (SELECT vid, vid IN (SELECT vid FROM ext) AS outer_one FROM pts)),
walk(i, seen, taken) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
SELECT t.i, CASE WHEN list_contains(w.seen, t.vid) THEN w.seen ELSE list_concat(w.seen, list_concat([t.vid], coalesce(a.ds, []))) END, CASE WHEN list_contains(w.seen, t.vid) THEN w.taken ELSE list_append(w.taken, t.vid) END
FROM walk w JOIN turn t ON t.i = w.i + 1 LEFT JOIN around a ON a.src = t.vid),
taken AS (SELECT unnest(taken) AS vid FROM walk WHERE i = (SELECT max(i) FROM turn))"""


def inside() -> str:
    e, r = [sub(f"p{i}", "p0") for i in (1, 2, 3)], sub("q", "p0")
    n = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    whole = dot(e[0], n[0])
    flat = "least(" + ", ".join(dot(x, x) for x in n) + ") < 1e-20"
    weights = ", ".join(f"{dot(r, x)} / {whole} AS w{i}" for i, x in enumerate(n))
    return f"hit AS (SELECT vid, tid, {flat} OR {whole} = 0 AS flat, {weights} FROM spot JOIN corner USING (g))"


def projected() -> str:
    s, t, r = sub("p1", "p0"), sub("p2", "p0"), sub("q", "p0")
    n = cross(s, t)
    return f"""proj AS (SELECT vid, tid, {dot(s, s)} AS ss, {dot(s, t)} AS st, {dot(t, t)} AS tt, {dot(r, s)} AS rs, {dot(r, t)} AS rt, abs({dot(n, r)}) / {norm(n)} AS height FROM spot JOIN corner USING (g)),
weighed AS (SELECT vid, tid, height, ss * tt - st * st AS d, (tt * rs - st * rt) / (ss * tt - st * st) AS v, (ss * rt - st * rs) / (ss * tt - st * st) AS w FROM proj)"""


EDGE = f"""ew AS (SELECT *, CASE WHEN {dot(sub('p2', 'p1'), sub('p2', 'p1'))} > 1e-20 THEN greatest(0.0, least(1.0, {dot(sub('p0', 'p1'), sub('p2', 'p1'))} / {dot(sub('p2', 'p1'), sub('p2', 'p1'))})) ELSE 0.0 END AS w FROM tp)"""
AWAY = "sqrt(" + " + ".join(f"(p0{a} - p1{a} - (p2{a} - p1{a}) * w) * (p0{a} - p1{a} - (p2{a} - p1{a}) * w)" for a in "xyz") + ")"
INVERSE = "iw AS (" + " UNION ALL ".join(f"SELECT tid AS f, v{i} AS \"to\", {norm(sub('p0', f'p{i}'))} AS d, {i} AS r FROM tp" for i in (1, 2, 3)) + "), hit AS (SELECT f, min(r) FILTER (d < 1e-12) AS h, sum(1 / d) FILTER (d >= 1e-12) AS total FROM iw GROUP BY 1)"
WAVE = " + ".join(f"cos(k * ({a} - (lo{a} + hi{a}) / 2))" for a in "xyz")
BOX = "box AS (SELECT " + ", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in "xyz") + " FROM pts), scaled AS (SELECT *, 4 * " + PI + " / greatest(hix - lox, hiy - loy, hiz - loz) AS k FROM box)"
OMEGAS = [2 / (2.0 + 0.2 - 1.8 * c) for c in (0.7071067811865476, -0.7071067811865475)]
JACOBI = "d AS (SELECT i, 1 / v AS v FROM lap WHERE i = j), x0 AS (SELECT i, 0.0::DOUBLE AS v FROM ramp)" + "".join(
    f", ax{k} AS (SELECT l.i, sum(l.v * x.v) AS v FROM lap l JOIN x{k} x ON x.i = l.j GROUP BY 1), x{k + 1} AS (SELECT x.i, x.v + {w!r} * coalesce(d.v * (coalesce(r.v, 0) - coalesce(a.v, 0)), 0) AS v FROM x{k} x LEFT JOIN d USING (i) LEFT JOIN rhs r USING (i) LEFT JOIN ax{k} a USING (i))"
    for k, w in enumerate(OMEGAS)
)

ORACLES: dict[str, str] = {
    "boundary_faces": sql([TETS, FACES], "SELECT tid, a, b, c FROM bfaces"),
    "boundary_vertices": sql([TETS, FACES], "SELECT DISTINCT unnest([a, b, c]) AS vid FROM bfaces"),
    "oriented_boundary": sql([TETS, FACES], "SELECT f0, f1, f2 FROM bfaces"),
    "cube_vertices": sql([cube(10)], f"SELECT vid, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM pts"),
    "cube_tets": sql([cube(10)], "SELECT tid, v0, v1, v2, v3 FROM tets"),
    "edges_distinct": sql(GRAPH, "SELECT a, b FROM und"),
    "vertex_degree": sql(GRAPH, "SELECT src AS vid, count(*) AS degree FROM adj GROUP BY 1"),
    "max_degree": sql(GRAPH, "SELECT max(n) AS most, count(*) AS n FROM (SELECT count(*) AS n FROM adj GROUP BY src)"),
    "neighbour_offsets": sql(GRAPH, "SELECT src AS vid, (sum(count(*)) OVER (ORDER BY src) - count(*))::BIGINT AS first, count(*) AS degree FROM adj GROUP BY 1"),
    "avg_edge_length": sql([PARTS, TETS, UND, LENGTHS], f"SELECT {r6('avg(len)')} AS avg_len, count(*) AS n_edges FROM el WHERE src < dst AND len > 0"),
    "bounding_box": sql([PARTS], "SELECT " + ", ".join(f"{r6(f'{f}({a})')} AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + " FROM pts"),
    "tet_volume": sql([*ORDER, POINTS], f"SELECT tid, {r6(f'abs({volume6("p0", "p1", "p2", "p3")}) / 6')} AS volume FROM tp"),
    "solid_angle_sum": sql([*ORDER, POINTS, corner_angles()], f"SELECT vid, {r6('omega')} AS omega FROM omega"),
    "exterior_vertices": sql([cube(10), POINTS, corner_angles(), EXTERIOR], f"SELECT vid, {r6('omega')} AS omega FROM ext"),
    "dihedral_sum": sql([*ORDER, POINTS, edge_angles()], f"SELECT a, b, {r6('theta')} AS theta FROM theta"),
    "exterior_edges": sql([cube(10), *CUBE_X], "SELECT a, b FROM xe"),
    "sharpness": sql([cube(10), *CUBE_X, SURFACE], f"SELECT vid, {r6('feature')} AS feature FROM feature"),
    "sharpness_order": sql([cube(6), *CUBE_X, SURFACE], "SELECT vid, row_number() OVER (ORDER BY round(feature, 6) DESC, vid) - 1 AS rank FROM feature"),
    "lumped_mass": sql([*ORDER, POINTS, MASS], f"SELECT i, {r6('v')} AS v FROM mass"),
    "stiffness_coo": sql([cube(10), POINTS, stiffness()], f"SELECT i, j, {r6('v')} AS v FROM stiff"),
    "manufactured_solution": sql([PARTS, BOX], f"SELECT vid AS i, {r6(f'({WAVE}) / 3')} AS v FROM pts, scaled"),
    "triangles": sql(WHOLE, "SELECT e.a, e.b, f.b AS c FROM g e JOIN g f ON f.a = e.b JOIN g h ON h.a = e.a AND h.b = f.b"),
    "four_cliques": sql([*WHOLE, "t AS (SELECT e.a, e.b, f.b AS c FROM g e JOIN g f ON f.a = e.b JOIN g h ON h.a = e.a AND h.b = f.b)"], "SELECT t.a, t.b, t.c, x.b AS d FROM t JOIN g x ON x.a = t.c JOIN g y ON y.a = t.a AND y.b = x.b JOIN g z ON z.a = t.b AND z.b = x.b"),
    "quotient_graph": sql([*GRAPH, GROUPS], "SELECT DISTINCT s.c AS src, d.c AS dst FROM adj JOIN lab s ON s.vid = src JOIN lab d ON d.vid = dst WHERE s.c <> d.c"),
    "graph_union": sql(GRAPH, "SELECT a, b FROM und WHERE (a + b) % 2 = 0 OR a % 3 = 0"),
    "graph_difference": sql(GRAPH, "SELECT a, b FROM und WHERE (a + b) % 2 = 0 AND a % 3 <> 0"),
    "edges_without_inner": sql(GRAPH, "SELECT a AS src, b AS dst FROM und WHERE a % 2 <> 0 OR b % 2 <> 0"),
    "complex_surface": sql([TETS, FACES], "SELECT f0, f1, f2 FROM (SELECT 0 AS o, a, b, c, f0, f1, f2 FROM bfaces UNION ALL SELECT DISTINCT 1, a, b, c, a, b, c FROM keyed) QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY o, f0, f1, f2) = 1"),
    "surface_depth": sql([cube(10), FACES], "SELECT vid, CASE WHEN vid IN (SELECT unnest([a, b, c]) FROM bfaces) THEN 0 ELSE 1 END AS depth FROM pts"),
    "nearest_coarse_vertex": sql([PARTS], f"SELECT vid, coarse_id, {r6('dist')} AS dist FROM (SELECT p.vid, q.vid AS coarse_id, {norm(sub('p.', 'q.'))} AS dist FROM pts p, pts q WHERE q.vid % 40 = 0) QUALIFY row_number() OVER (PARTITION BY vid ORDER BY dist, coarse_id) = 1"),
    "surface_remap": sql([TETS, FACES, "m AS (SELECT a // 25 AS x, b // 25 AS y, c // 25 AS z FROM bfaces)"], "SELECT DISTINCT least(x, y, z) AS a, x + y + z - least(x, y, z) - greatest(x, y, z) AS b, greatest(x, y, z) AS c FROM m WHERE x <> y AND y <> z AND x <> z"),
    "spmv": sql(LINEAR, f"SELECT i, {r6('v')} AS v FROM rhs"),
    "spmv_transposed": sql([RAMP, BRANDS], f"SELECT p.j AS i, {r6('sum(p.v * x.v)')} AS v FROM p JOIN ramp x ON x.i = p.i GROUP BY 1"),
    "spmm": sql([TETS, UND, LAP, BRANDS], f"SELECT l.i, p.j, {r6('sum(l.v * p.v)')} AS v FROM lap l JOIN p ON p.i = l.j GROUP BY 1, 2"),
    "laplacian_squared_rows": sql([TETS, UND, LAP], "SELECT i, count(*) AS n_entries, sum(v * v) AS sum_squares FROM (SELECT l.i, m.j, sum(l.v * m.v) AS v FROM lap l JOIN lap m ON m.i = l.j GROUP BY 1, 2) GROUP BY 1"),
    "galerkin_rap": sql([TETS, UND, LAP, BRANDS], f"SELECT q.j AS i, p.j, {r6('sum(l.v)')} AS v FROM lap l JOIN p ON p.i = l.j JOIN p q ON q.i = l.i GROUP BY 1, 2"),
    "dirichlet_matrix": sql([TETS, UND, LAP, RAMP], "SELECT i, j, v FROM lap WHERE i % 10 <> 0 AND j % 10 <> 0 UNION ALL SELECT i, i, 1.0 FROM ramp WHERE i % 10 = 0"),
    "dirichlet_right_side": sql([*LINEAR, "moved AS (SELECT l.i, sum(l.v * x.v) AS v FROM lap l JOIN ramp x ON x.i = l.j WHERE x.i % 10 = 0 GROUP BY 1)"], f"SELECT i, {r6('rhs.v - coalesce(moved.v, 0)')} AS v FROM rhs LEFT JOIN moved USING (i) WHERE i % 10 <> 0 UNION ALL SELECT i, v FROM ramp WHERE i % 10 = 0"),
    "poisson_matrix": sql([cube(6), POINTS, stiffness(), MASS], f"SELECT i, j, {r6('sum(v)')} AS v FROM (SELECT * FROM stiff UNION ALL SELECT i, i, 1e-3 * v FROM mass) GROUP BY 1, 2"),
    "biharmonic_matrix": sql([cube(6), POINTS, stiffness(), MASS], f"SELECT s.i, t.j, {r6('sum(s.v * t.v * CASE WHEN abs(m.v) > 1e-30 THEN 1 / m.v ELSE 0 END)')} AS v FROM stiff s JOIN mass m ON m.i = s.j JOIN stiff t ON t.i = s.j GROUP BY 1, 2"),
    "diag_inverse": sql([TETS, UND, LAP], f"SELECT p_partkey AS i, {r6('coalesce(1 / v, 0.0)')} AS v FROM part LEFT JOIN (SELECT * FROM lap WHERE i = j) ON i = p_partkey"),
    "zero_diagonals": sql([TETS, UND, LAP], "SELECT count(*) AS n_zero FROM part WHERE p_partkey NOT IN (SELECT i FROM lap WHERE i = j)"),
    "vector_add": sql(LINEAR, f"SELECT i, {r6('sum(v)')} AS v FROM (SELECT i, v FROM ramp UNION ALL SELECT i, -0.5 * v FROM rhs) GROUP BY 1"),
    "weighted_norm": sql([RAMP], f"SELECT {r6('sqrt(sum(v * v / (1 + i % 5)))')} AS norm FROM ramp"),
    "relative_error": sql([RAMP], f"SELECT {r6('sqrt(sum((i % 3) * (i % 3))::DOUBLE) / greatest(sqrt(sum((v + i % 3) * (v + i % 3))), 1e-30)')} AS relative FROM ramp"),
    "jacobi_sweeps": sql([*LINEAR, JACOBI], f"SELECT i, {r6('v')} AS v FROM x2"),
    "power_iteration": sql([TETS, UND, LAP, RAMP, "d AS (SELECT i, 1 / v AS v FROM lap WHERE i = j), y1 AS (SELECT l.i, sum(l.v * x.v) * any_value(d.v) AS v FROM lap l JOIN ramp x ON x.i = l.j JOIN d ON d.i = l.i GROUP BY 1), y2 AS (SELECT l.i, sum(l.v * x.v) * any_value(d.v) AS v FROM lap l JOIN y1 x ON x.i = l.j JOIN d ON d.i = l.i GROUP BY 1)"], f"SELECT {r6('sqrt((SELECT sum(v * v) FROM y2)) / sqrt((SELECT sum(v * v) FROM y1))')} AS growth"),
    "chebyshev_coefficients": sql([*GRAPH, "m AS (SELECT max(n)::DOUBLE AS m FROM (SELECT count(*) AS n FROM adj GROUP BY src))"], f"SELECT k::INTEGER AS k, {r6(f'2 / (m + m / 10 - (m - m / 10) * cos({PI} * (2 * k + 1) / 4))')} AS omega FROM m, range(2) r(k)"),
    "partition_of_unity": "SELECT round(max(off), 6) + 0.0 AS worst, arg_max(vid, {'o': off, 'v': -vid}) AS row, count(*) FILTER (off > 1e-10) AS n_off FROM (SELECT p_partkey AS vid, CASE WHEN p_partkey % 100 = 7 THEN 0.25 ELSE 0.0 END::DOUBLE AS off FROM part)",
    "negative_entries": sql([TETS, UND, LAP], f"SELECT count(*) FILTER (v < -1e-12) AS n_negative, {r6('min(v)')} AS least, (SELECT i FROM lap ORDER BY v, i, j LIMIT 1) AS i, (SELECT j FROM lap ORDER BY v, i, j LIMIT 1) AS j FROM lap"),
    "cluster_k_hops": sql([PARTS, TETS, UND, LENGTHS, SEEDS], f"SELECT vid, coarse_id, {r6('dist')} AS dist FROM (SELECT vid, vid // 40 AS coarse_id, 0.0::DOUBLE AS dist FROM seed UNION ALL SELECT dst, vid // 40, len FROM el JOIN seed ON vid = src UNION ALL SELECT f.dst, vid // 40, e.len + f.len FROM el e JOIN seed ON vid = e.src JOIN el f ON f.src = e.dst) QUALIFY row_number() OVER (PARTITION BY vid ORDER BY dist, coarse_id) = 1"),
    "cluster_all_hops": f"WITH RECURSIVE {', '.join([PARTS, TETS, UND, LENGTHS, SEEDS])}, {SHORTEST}\nSELECT vid, coarse_id, {r6('dist')} AS dist FROM best",
    "two_hop_reach": sql([PARTS, TETS, UND, LENGTHS], f"SELECT src, dst, {r6('min(dist)')} AS dist FROM (SELECT src, dst, len AS dist FROM el UNION ALL SELECT e.src, f.dst, e.len + f.len FROM el e JOIN el f ON f.src = e.dst WHERE e.src <> f.dst AND e.len < 0.4 AND f.len < 0.4) WHERE dist < 0.4 GROUP BY 1, 2"),
    "best_tet_per_point": sql([*ORDER, POINTS, SPOTS, inside(), "scored AS (SELECT vid, tid, round(CASE WHEN flat OR least(w0, w1, w2, 1 - w0 - w1 - w2) < 0 THEN -1.0 ELSE least(w0, w1, w2, 1 - w0 - w1 - w2) END, 6) + 0.0 AS metric FROM hit)"], "SELECT vid, tid, metric FROM scored WHERE metric > -0.5 QUALIFY row_number() OVER (PARTITION BY vid ORDER BY metric, tid) = 1"),
    "best_triangle_per_point": sql([*ORDER, POINTS, SPOTS, projected(), "scored AS (SELECT vid, tid, round(height, 6) + 0.0 AS height FROM weighed WHERE abs(d) >= 1e-12 AND least(1 - v - w, v, w) >= -1e-5)"], "SELECT vid, tid, height FROM scored QUALIFY row_number() OVER (PARTITION BY vid ORDER BY height, tid) = 1"),
    "edge_projection_weights": sql([*ORDER, POINTS, EDGE], f"SELECT tid, {r6('w')} AS w, {r6(AWAY)} AS away FROM ew"),
    "inverse_distance_weights": sql([*ORDER, POINTS, INVERSE], f"SELECT f, \"to\", {r6('CASE WHEN h IS NOT NULL THEN CASE WHEN h = r THEN 1.0 ELSE 0.0 END ELSE 1 / d / total END')} AS v FROM iw JOIN hit USING (f)"),
    "case_histogram": f"SELECT (p_partkey * 7 % 5)::INTEGER AS kind, count(*) AS n, {r6('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM part GROUP BY 1",
    "residual_curve": f"SELECT o_custkey::VARCHAR AS problem, (row_number() OVER w - 1)::INTEGER AS cycle, {r6('sum((o_orderkey % 10)::DOUBLE) OVER w / 1000')} AS seconds, {r6('CASE WHEN o_totalprice / first_value(o_totalprice) OVER w > 0 THEN o_totalprice / first_value(o_totalprice) OVER w ELSE 1e-16 END')} AS relative FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "stage_totals": "SELECT o_orderpriority AS stage, sum((o_orderkey % 100)::DOUBLE) AS ms, count(*) AS levels FROM orders GROUP BY 1",
    "count_labels": "SELECT o_orderkey, CASE WHEN (o_orderkey * 1700 + 13) >= 1000000 THEN printf('%.1fM', (o_orderkey * 1700 + 13) / 1e6) WHEN (o_orderkey * 1700 + 13) >= 1000 THEN printf('%.0fk', (o_orderkey * 1700 + 13) / 1e3) ELSE (o_orderkey * 1700 + 13)::VARCHAR END AS label FROM orders",
    "cube_disk_sample": f"WITH RECURSIVE {', '.join([cube(6), POINTS, UND, corner_angles(), EXTERIOR, WALK])}\nSELECT row_number() OVER (ORDER BY i) - 1 AS coarse_id, vid AS fine_vid, outer_one AS is_exterior FROM taken JOIN turn USING (vid)",
    "ply_round_trip": sql([TETS], "SELECT row_number() OVER (ORDER BY tid) - 1 AS tid, v0, v1, v2, v3 FROM tets"),
}
