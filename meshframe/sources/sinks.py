"""What a run leaves behind: interpolation archives, level surfaces and summaries."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from meshframe.operators import topology
from meshframe.plans import hierarchy as H
from meshframe.plans.multigrid import LocalMatrix, Result
from meshframe.sources import ply


def save_prolongations(h: H.Hierarchy, path: str) -> None:
    """Every interpolation matrix as compressed rows: P_k_data, _indices, _indptr and _shape."""
    out = {}
    for k, (low, high) in enumerate(zip(h.levels, h.levels[1:], strict=False)):
        got = high.p.toArrow()
        m = LocalMatrix(*[got.column(c).to_numpy() for c in "ijv"], (low.n, high.n))
        out |= {f"P_{k}_data": m.v, f"P_{k}_indices": m.j.astype(np.int32), f"P_{k}_indptr": np.concatenate([[0], np.cumsum(np.bincount(m.i, minlength=low.n))]), f"P_{k}_shape": np.array(m.shape)}
    np.savez_compressed(path, **out)


def save_prolongation_tables(h: H.Hierarchy, folder: str) -> None:
    """The same as Parquet, one folder a level, for use at scale."""
    for k, level in enumerate(h.levels[1:]):
        level.p.write.mode("overwrite").parquet(f"{folder}/level={k}")


def save_levels(h: H.Hierarchy, folder: str) -> list[Path]:
    """A surface file for each level."""
    out = []
    for k, level in enumerate(h.levels):
        faces = H.surface(h, k)
        path = Path(folder, f"level_{k:02d}.ply")
        ply.write_surface_ply(str(path), level.vertices, faces, topology.surface_depth(level.vertices, faces))
        out.append(path)
    return out


def save_timing(h: H.Hierarchy, path: str) -> None:
    if path:
        Path(path).write_text(json.dumps(H.timing_document(h), indent=2) + "\n")


def summary(spark: SparkSession, label: str, h: H.Hierarchy, results: list[Result]) -> dict:
    sizes = [r.asDict() for r in h.sizes(spark).orderBy("level").collect()]
    return {
        "label": label, "num_vertices": sizes[0]["vertices"], "num_tetrahedra": sizes[0]["tetrahedra"], "hierarchy_levels": len(sizes), "hierarchy_build_ms": h.total_ms,
        "hierarchy_level_sizes": sizes, "stopped": h.stopped, "problems": {r.problem: r.summary() for r in results},
    }


def save_summary(document: dict, path: str) -> None:
    Path(path).write_text(json.dumps(document, indent=2) + "\n")
