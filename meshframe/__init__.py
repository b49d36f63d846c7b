"""Unstructured tetrahedral meshes, their graphs and sparse matrices as Spark DataFrames."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

#: Public names and the modules that define them; they load on first use.
_PUBLIC = {
    "Mesh": "plans.engine", "Solver": "plans.engine", "create_solver": "plans.engine",
    "assemble_problem": "operators.pde", "solve_problem": "plans.multigrid", "build_hierarchy": "plans.engine",
    "make_cube_mesh": "plans.engine", "make_mesh_from_ply": "plans.engine",
    "run_demo": "plans.demo", "run_suite": "plans.demo", "parse_common_args": "plans.demo",
}
__all__ = [*_PUBLIC, "version"]


def version() -> str:
    return __version__


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module 'meshframe' has no attribute {name!r}")
    return getattr(import_module(f"meshframe.{_PUBLIC[name]}"), name)
