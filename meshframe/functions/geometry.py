"""Geometry as Column expressions over points.

A point is a struct column with x, y and z, or a ``Vec`` of three columns. What is computed stays a ``Vec``, so
that taking a coordinate doesn't repeat the expressions of the other two."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass
class Vec:
    x: Column
    y: Column
    z: Column

    def __getitem__(self, axis: str) -> Column:
        return getattr(self, axis)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def alias(self, name: str) -> Column:
        return self.struct().alias(name)


Point = Column | Vec


def point(x: Column, y: Column, z: Column) -> Vec:
    return Vec(x, y, z)


def sub(p: Point, q: Point) -> Vec:
    return point(*[p[a] - q[a] for a in AXES])


def add(p: Point, q: Point) -> Vec:
    return point(*[p[a] + q[a] for a in AXES])


def scale(p: Point, s: Column) -> Vec:
    return point(*[p[a] * s for a in AXES])


def dot(p: Point, q: Point) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def cross(p: Point, q: Point) -> Vec:
    return point(p["y"] * q["z"] - p["z"] * q["y"], p["z"] * q["x"] - p["x"] * q["z"], p["x"] * q["y"] - p["y"] * q["x"])


def norm(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def distance(p: Column, q: Column) -> Column:
    return norm(sub(p, q))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def solid_angle(apex: Column, p: Column, q: Column, r: Column) -> Column:
    """The solid angle at ``apex``; 0 when an edge there is shorter than 1e-14."""
    a, b, c = sub(p, apex), sub(q, apex), sub(r, apex)
    la, lb, lc = norm(a), norm(b), norm(c)
    below = la * lb * lc + la * dot(b, c) + lb * dot(a, c) + lc * dot(a, b)
    angle = F.abs(2 * F.atan2(dot(a, cross(b, c)), below))
    return F.when(F.least(la, lb, lc) < 1e-14, F.lit(0.0)).otherwise(angle)


def dihedral_angle(a: Column, b: Column, p: Column, q: Column) -> Column:
    """The angle at edge a-b between the faces towards p and q; 0 when degenerate."""
    edge = sub(b, a)
    u, w = cross(edge, sub(p, a)), cross(edge, sub(q, a))  # the perpendicular parts, turned and scaled alike
    length, lu, lw = norm(edge), norm(u), norm(w)
    angle = F.acos(clamp(F.try_divide(dot(u, w), lu * lw), -1.0, 1.0))
    return F.when((length < 1e-14) | (F.least(lu, lw) < 1e-14 * length), F.lit(0.0)).otherwise(angle)


def signed_volume6(a: Column, b: Column, c: Column, d: Column) -> Column:
    return dot(sub(b, a), cross(sub(c, a), sub(d, a)))


def volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.abs(signed_volume6(a, b, c, d)) / 6


def gradients(a: Column, b: Column, c: Column, d: Column) -> list[Vec]:
    """The gradients of the four barycentric coordinates: opposite-face normals over six volumes."""
    inverse = F.try_divide(F.lit(1.0), signed_volume6(a, b, c, d))
    faces = [cross(sub(d, b), sub(c, b)), cross(sub(c, a), sub(d, a)), cross(sub(d, a), sub(b, a)), cross(sub(b, a), sub(c, a))]
    return [scale(f, inverse) for f in faces]


def staged(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """A value through steps, each of which sees the last one's result as a bound variable: the expression grows with
    the sum of the steps, where columns of their own would be merged again into one that grows with their product."""
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return F.element_at(held, 1)


def named(v: Point, name: str) -> list[Column]:
    """The coordinates of a point as columns name_x, name_y and name_z."""
    return [v[a].alias(f"{name}_{a}") for a in AXES]


def held(name: str) -> Vec:
    """The point that ``named`` made columns of."""
    return Vec(*[F.col(f"{name}_{a}") for a in AXES])


def tet_frames(df: DataFrame, corners: list[str], margin: float = 1e-9) -> DataFrame:
    """``df`` without its flat tets, and with what the coordinates of points in the tet of point columns ``corners`` need, as
    plain columns: they are worked out once a tet, so that a pair of a point and a tet takes but a few products."""
    a = F.col(corners[0])
    sides = F.struct(*[sub(F.col(c), a).alias(n) for c, n in zip(corners[1:], "bcd", strict=True)])
    normals = lambda s: F.struct(s["b"].alias("b"), cross(s["c"], s["d"]).alias("nb"), cross(s["d"], s["b"]).alias("nc"), cross(s["b"], s["c"]).alias("nd"))
    whole = lambda s: F.struct(dot(s["b"], s["nb"]).alias("whole"), F.least(*[dot(s[n], s[n]) for n in ("nb", "nc", "nd")]).alias("least"), *[s[n].alias(n) for n in ("nb", "nc", "nd")])
    made = df.withColumn("_tet", staged(sides, normals, whole)).where("not (_tet.least < 1e-20 or _tet.whole = 0)")
    at = {x: [F.col(c)[x] for c in corners] for x in AXES}
    box = [c for x in AXES for c in ((F.least(*at[x]) - margin).alias(f"_low_{x}"), (F.greatest(*at[x]) + margin).alias(f"_high_{x}"))]
    return made.select("*", *named(a, "_o"), *[c for n in ("nb", "nc", "nd") for c in named(F.col("_tet")[n], f"_{n}")], F.col("_tet.whole").alias("_whole"), *box).drop("_tet")


def in_frame_box(p: Point) -> Column:
    """Whether p lies in the box of its row's tet frame; no point of the tet lies outside."""
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (p[a] >= F.col(f"_low_{a}")) & (p[a] <= F.col(f"_high_{a}"))
    return inside


def tet_coordinates(p: Point) -> tuple[list[Column], Column]:
    """The barycentric coordinates of p in the tet of its row's frame (the first by complement), and the metric: the
    smallest of them, or -1 when p is outside."""
    r = sub(p, held("_o"))
    three = [F.try_divide(dot(r, held(n)), F.col("_whole")) for n in ("_nb", "_nc", "_nd")]
    w = [1 - three[0] - three[1] - three[2], *three]
    least = F.least(*w)
    return w, F.when(least < 0, F.lit(-1.0)).otherwise(least)


def edge_weight(p: Column, a: Column, b: Column) -> Column:
    """The weight of b when p is projected on edge a-b and clamped to it; 0 on an edge without length."""
    e = sub(b, a)
    square = dot(e, e)
    return F.when(square > 1e-20, clamp(F.try_divide(dot(sub(p, a), e), square), 0.0, 1.0)).otherwise(F.lit(0.0))


def edge_offset(p: Column, a: Column, b: Column) -> Vec:
    """From the point of edge a-b nearest to p, to p."""
    return sub(sub(p, a), scale(sub(b, a), edge_weight(p, a, b)))


def edge_distance(p: Column, a: Column, b: Column) -> Column:
    return norm(edge_offset(p, a, b))


def triangle_frames(df: DataFrame, corners: list[str]) -> DataFrame:
    """``df`` without its degenerate triangles, and with what projections on the triangle of point columns ``corners`` need,
    as plain columns (see ``tet_frames``)."""
    a = F.col(corners[0])
    sides = F.struct(*[sub(F.col(c), a).alias(n) for c, n in zip(corners[1:], "st", strict=True)])
    products = lambda x: F.struct(*[dot(x[i], x[j]).alias(i + j) for i, j in ("ss", "st", "tt")], x["s"].alias("s"), x["t"].alias("t"), cross(x["s"], x["t"]).alias("n"))
    whole = lambda x: F.struct((x["ss"] * x["tt"] - x["st"] * x["st"]).alias("whole"), norm(x["n"]).alias("size"), *[x[n].alias(n) for n in ("ss", "st", "tt", "s", "t", "n")])
    made = df.withColumn("_triangle", staged(sides, products, whole)).where("not abs(_triangle.whole) < 1e-12")
    scalars = [F.col(f"_triangle.{n}").alias(f"_{n}") for n in ("ss", "st", "tt", "whole", "size")]
    return made.select("*", *named(a, "_o"), *[c for n in "stn" for c in named(F.col("_triangle")[n], f"_{n}")], *scalars).drop("_triangle")


def triangle_projection(p: Point) -> tuple[Column, list[Column]]:
    """The distance of p to the plane of its row's triangle frame, or null when the projection is outside, and the
    coordinates of the projection."""
    r = sub(p, held("_o"))
    rs, rt = dot(r, held("_s")), dot(r, held("_t"))
    w1 = F.try_divide(F.col("_tt") * rs - F.col("_st") * rt, F.col("_whole"))
    w2 = F.try_divide(F.col("_ss") * rt - F.col("_st") * rs, F.col("_whole"))
    w = [1 - w1 - w2, w1, w2]
    height = F.try_divide(F.abs(dot(held("_n"), r)), F.col("_size"))
    return F.when(F.least(*w) >= -1e-5, height), w


def safe_inverse(c: Column, epsilon: float) -> Column:
    """1/c, or 0 where c is within epsilon of 0."""
    return F.when(F.abs(c) > epsilon, F.try_divide(F.lit(1.0), c)).otherwise(F.lit(0.0))


def chebyshev_omegas(largest: float, degree: int = 2) -> list[float]:
    """Smoother weights for the upper part [largest / 10, largest] of a spectrum."""
    low = largest / 10
    return [2 / (largest + low - (largest - low) * math.cos(math.pi * (2 * k + 1) / (2 * degree))) for k in range(degree)]


def render_rotation(p: Point) -> Vec:
    """(x, y, z) to (x, -z, y)."""
    return point(p["x"], -p["z"], p["y"])


def count_label(n: Column) -> Column:
    """1.4M, 205k or the number itself."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.0fk", n / 1e3)).otherwise(n.cast("string"))
