"""Finite elements on tetrahedra: stiffness, lumped mass, the two model problems and Dirichlet conditions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import sparse
from meshframe.operators.topology import bounding_box, boundary_vertices, tet_points
from meshframe.storage import settle

# Shifts and tolerances of the model problems.
SHIFT = {"poisson": 1e-3, "biharmonic": 0.0}
TOLERANCE = {"poisson": 1e-8, "biharmonic": 1e-5}
CYCLES = 2.0


def stiffness(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """(i, j, v): the sum over tets of volume times the products of gradients."""
    p = [F.col(f"p{i}") for i in range(4)]
    local = tet_points(tets, vertices).withColumns({"vol": G.volume(*p), **{f"g{i}": g.struct() for i, g in enumerate(G.gradients(*p))}}).where("vol > 0")
    rows = F.array(*[F.struct(F.col(f"v{i}").alias("i"), F.col(f"v{j}").alias("j"), (F.col("vol") * G.dot(F.col(f"g{i}"), F.col(f"g{j}"))).alias("v")) for i in range(4) for j in range(4)])
    return sparse.reduce_entries(local.select(F.inline(rows)))


def lumped_mass(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """(i, v): a quarter of the volume of each tet goes to each of its corners."""
    share = tet_points(tets, vertices).select(*[f"v{i}" for i in range(4)], (G.volume(*[F.col(f"p{i}") for i in range(4)]) / 4).alias("v"))
    return share.select(F.explode(F.array(*[f"v{i}" for i in range(4)])).alias("i"), "v").groupBy("i").agg(F.sum("v").alias("v"))


def manufactured_solution(vertices: DataFrame, cycles: float = CYCLES) -> DataFrame:
    """(i, v): the mean over the axes of cos(k (coordinate - centre)), k from the largest extent."""
    box = bounding_box(vertices).withColumn("k", 2 * math.pi * cycles / F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in G.AXES]))
    wave = sum(F.cos(F.col("k") * (F.col(a) - (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2)) for a in G.AXES) / 3
    return vertices.crossJoin(F.broadcast(box)).select(F.col("vid").alias("i"), wave.alias("v"))


def system_matrix(name: str, s: DataFrame, mass: DataFrame) -> DataFrame:
    """S + shift M, or S M^-1 S + shift M."""
    if name not in SHIFT:
        raise ValueError(f"unknown problem {name!r}")
    if name == "biharmonic":
        inverse = mass.select("i", G.safe_inverse(F.col("v"), 1e-30).alias("v"))
        return sparse.spmm(s, sparse.scale_rows(s, inverse))
    return sparse.add(s, mass.select("i", F.col("i").alias("j"), "v"), 1.0, SHIFT[name])


def dirichlet(a: DataFrame, b: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symmetric elimination of ``fixed`` (i, v): (matrix, right side)."""
    ids = fixed.select("i")
    free = a.join(ids, "i", "left_anti").join(ids.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "v")
    unit = ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    moved = sparse.add(b, sparse.spmv(a, fixed), 1.0, -1.0).join(ids, "i", "left_anti")
    return free.unionByName(unit), moved.unionByName(fixed.select("i", "v"))


@dataclass
class Problem:
    name: str
    a: DataFrame
    b: DataFrame
    x_true: DataFrame
    mass: DataFrame
    fixed: DataFrame
    tolerance: float
    n_vertices: int
    n_tets: int


def assemble_problem(vertices: DataFrame, tets: DataFrame, name: str) -> Problem:
    """The model problem on a mesh, with its manufactured solution and boundary values."""
    if name not in SHIFT:
        raise ValueError(f"unknown problem {name!r}")
    mass, s = settle(lumped_mass(vertices, tets), "mass"), settle(stiffness(vertices, tets), "stiffness")
    x = settle(manufactured_solution(vertices), "x")
    full = settle(system_matrix(name, s, mass), "matrix")
    fixed = settle(boundary_vertices(tets).select(F.col("vid").alias("i")).join(x, "i"), "fixed")
    a, b = dirichlet(full, sparse.spmv(full, x), fixed)
    return Problem(name, settle(a, "system"), settle(b, "right"), x, mass, fixed.select("i"), TOLERANCE[name], vertices.count(), tets.count())
