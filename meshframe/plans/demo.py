"""Runs from a mesh to files: ``python -m meshframe.plans.demo --cube 20 --output out``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from meshframe.operators import pde
from meshframe.plans import hierarchy, multigrid
from meshframe.sources import cube, ply, sinks

Mesh = tuple[DataFrame, DataFrame]
#: The files of a run.
OUTPUTS = ("level_*.ply", "prolongations.npz", "hierarchy_timing.json", "summary.json")


def run_suite(spark: SparkSession, mesh: Mesh, label: str, output: str | None = None, problems: list[str] | None = None, max_cycles: int = 150, settings: hierarchy.Settings | None = None) -> dict:
    """Build the hierarchy once, solve the problems on it, and write the results if all of them ran."""
    problems = problems or list(pde.SHIFT)
    if unknown := set(problems) - set(pde.SHIFT):
        raise ValueError(f"unknown problems {sorted(unknown)}")
    settings = settings or hierarchy.demo_settings()
    h = hierarchy.build(*mesh, settings)
    results = [multigrid.solve_problem(h, pde.assemble_problem(*mesh, name), max_cycles, dense_coarse=settings.dense_coarse) for name in problems]
    document = sinks.summary(spark, label, h, results)
    if output:
        clean(output)
        Path(output).mkdir(parents=True, exist_ok=True)
        sinks.save_levels(h, output)
        sinks.save_prolongations(h, f"{output}/prolongations.npz")
        sinks.save_timing(h, f"{output}/hierarchy_timing.json")
        sinks.save_summary(document, f"{output}/summary.json")
    return document


def run_demo(spark: SparkSession, label: str, build_mesh: Callable[[SparkSession], Mesh], **more) -> dict:
    """``run_suite`` on what the caller's function builds."""
    return run_suite(spark, build_mesh(spark), label, **more)


def main(argv: list[str] | None = None) -> int:
    args = parse_common_args(argv)
    if args.clean:
        clean(args.output)
        return 0
    spark = SparkSession.builder.appName("meshframe").getOrCreate()
    settings = hierarchy.demo_settings()
    settings.verbose = args.verbose
    made = run_demo(spark, args.ply or f"cube {args.cube}", lambda s: ply.read_mesh(s, args.ply, args.parts) if args.ply else cube.cube_mesh(s, args.cube), output=args.output, problems=args.problems, max_cycles=args.max_cycles, settings=settings)
    for name, r in made["problems"].items():
        print(f"{name}: {'converged' if r['converged'] else 'not converged'} after {r['num_cycles']} cycles, relative error {r['relative_error']:.3g}, residual {r['relative_residual']:.3g}")
    failed = accepted(made) if args.smoke else [name for name, r in made["problems"].items() if not r["converged"]]
    for line in failed:
        print("failed:", line)
    return 1 if failed else 0


def accepted(document: dict) -> list[str]:
    """What speaks against a run as a smoke test."""
    out = []
    for name, r in document["problems"].items():
        bad = {"it didn't converge": not r["converged"], "it timed out": r["timed_out"], "its residual": r["relative_residual"] > max(10 * r["tolerance"], 1e-10), "its error": r["relative_error"] > 1e-4}
        out += [f"{name}: {what}" for what, is_so in bad.items() if is_so]
    return out


def clean(output: str | None) -> list[str]:
    """Delete what ``run_suite`` left in a folder, and the folder if nothing else is in it; which files went."""
    gone = []
    for pattern in OUTPUTS if output else ():
        for path in sorted(Path(output).glob(pattern)):
            path.unlink()
            gone.append(path.name)
    if output and Path(output).is_dir() and not any(Path(output).iterdir()):
        Path(output).rmdir()
    return gone


def parse_common_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    source = parser.add_mutually_exclusive_group(required="--clean" not in (sys.argv[1:] if argv is None else argv))
    source.add_argument("--cube", type=int, help="points per side of a generated cube")
    source.add_argument("--ply", help="a tetrahedral PLY file")
    parser.add_argument("--problems", nargs="+", choices=list(pde.SHIFT))
    parser.add_argument("--max-cycles", type=int, default=500)
    parser.add_argument("--output", help="folder for levels, interpolation, timing and summary")
    parser.add_argument("--parts", help="folder with the parts of a missing PLY file")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--smoke", action="store_true", help="fail unless residual and error are as small as they should be")
    parser.add_argument("--clean", action="store_true", help="delete the files of earlier runs in the output folder, and stop")
    return parser.parse_args(argv)


if __name__ == "__main__":
    sys.exit(main())
