"""A mesh and a solver as objects: the whole surface over the tables in one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meshframe.operators import pde, topology
from meshframe.plans import hierarchy, multigrid
from meshframe.sources import cube, ply


@dataclass
class Mesh:
    """Vertices (vid, x, y, z) and tetrahedra (tid, v0..v3); unpacks like the pair of them."""

    vertices: DataFrame
    tetrahedra: DataFrame

    def __iter__(self):
        return iter((self.vertices, self.tetrahedra))

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_tetrahedra(self) -> int:
        return self.tetrahedra.count()


def make_cube_mesh(spark: SparkSession, resolution: int) -> Mesh:
    return Mesh(*cube.cube_mesh(spark, resolution))


def make_mesh_from_ply(spark: SparkSession, path: str, parts: str | None = None) -> Mesh:
    """A mesh file, put together from the parts in folder ``parts`` if it is missing."""
    return Mesh(*ply.read_mesh(spark, path, parts))


def build_hierarchy(mesh: Mesh, settings: hierarchy.Settings | None = None) -> hierarchy.Hierarchy:
    return hierarchy.build(*mesh, settings or hierarchy.demo_settings())


class Solver:
    """Hierarchy and V-cycle of one mesh, with what has been done so far."""

    def __init__(self, mesh: Mesh, settings: hierarchy.Settings | None = None):
        self.mesh, self.settings = mesh, settings or hierarchy.Settings()
        self.clear()

    def clear(self) -> None:
        """Forget hierarchy and results."""
        self.hierarchy: hierarchy.Hierarchy | None = None
        self.result: multigrid.Result | None = None

    def build_hierarchy(self) -> hierarchy.Hierarchy:
        self.clear()
        topology.check_mesh(*self.mesh)
        self.hierarchy = hierarchy.build(*self.mesh, self.settings)
        return self.hierarchy

    def solve(self, problem: str | pde.Problem, max_cycles: int = 150) -> multigrid.Result:
        """Solve a named problem, or an assembled one, from a zero start; builds the hierarchy if there is none."""
        built = self.hierarchy or self.build_hierarchy()
        ready = pde.assemble_problem(*self.mesh, problem) if isinstance(problem, str) else problem
        self.result = multigrid.solve_problem(built, ready, max_cycles, dense_coarse=self.settings.dense_coarse)
        return self.result

    def is_hierarchy_built(self) -> bool:
        return self.hierarchy is not None

    def num_levels(self) -> int:
        return len(self.hierarchy.levels) if self.hierarchy else 0

    def level_sizes(self) -> list[int]:
        return [level.n for level in self.hierarchy.levels] if self.hierarchy else []

    def is_converged(self) -> bool:
        return self.result is not None and self.result.converged

    def residual_history(self) -> list[float]:
        return list(self.result.residual_history) if self.result else []


def create_solver(mesh: Mesh) -> Solver:
    """A solver with the demos' settings."""
    return Solver(mesh, hierarchy.demo_settings())
