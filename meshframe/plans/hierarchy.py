"""The hierarchy of coarser and coarser meshes and the interpolation matrices between them."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions import geometry as G
from meshframe.operators import cliques, coarsen, exterior, prolong, sampling, topology
from meshframe.storage import settle

#: Interior vertices come after all exterior ones in the sampling order.
LAST = 1 << 62


@dataclass
class Settings:
    min_verts: int = 500
    max_levels: int = 100
    search_radius_factor: float = 2.0
    local: int = sampling.LOCAL
    corrected: bool = False
    #: Whether sharp exterior vertices come first at the finest level; by id otherwise.
    feature_preserve: bool = True
    #: Whether the coarsest operator is factorised; conjugate gradients otherwise.
    dense_coarse: bool = True
    verbose: bool = False


def demo_settings() -> Settings:
    return Settings(min_verts=200, max_levels=25)


@dataclass
class Level:
    """Level 0 has no samples; later levels have what made them."""

    vertices: DataFrame
    edges: DataFrame
    exterior: DataFrame  # vid, rank
    ext_edges: DataFrame  # src, dst, len
    n: int
    tets: DataFrame | None = None
    triangles: DataFrame | None = None
    samples: DataFrame | None = None
    clusters: DataFrame | None = None
    p: DataFrame | None = None
    cases: DataFrame | None = None


@dataclass
class Hierarchy:
    levels: list[Level]
    timings: list[tuple[int, str, float]] = field(default_factory=list)
    stopped: str = ""

    def sizes(self, spark: SparkSession) -> DataFrame:
        rows = [(k, x.n, 0 if x.tets is None else x.tets.count()) for k, x in enumerate(self.levels)]
        return spark.createDataFrame(rows, "level int, vertices bigint, tetrahedra bigint")

    def stage_timing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.timings, "level int, stage string, ms double")

    @property
    def total_ms(self) -> float:
        return sum(ms for _, _, ms in self.timings)


@contextmanager
def stage(h: Hierarchy, level: int, name: str):
    began = time.perf_counter()
    try:
        yield
    finally:
        h.timings.append((level, name, (time.perf_counter() - began) * 1e3))


def finest(vertices: DataFrame, tets: DataFrame, settings: Settings | None = None) -> Level:
    edges = settle(topology.with_length(topology.adjacency(tets), vertices), "edges")
    ext = settle(exterior.exterior_vertices(vertices, tets).select("vid"), "exterior")
    ext_edges = settle(exterior.exterior_edges(vertices, tets, ext, edges), "ext-edges")
    settings = settings or Settings()
    if settings.feature_preserve:
        features = settle(exterior.sharpness(vertices, ext, ext_edges, edges), "features")
        order = settle(exterior.by_feature(features), "order")
        if settings.verbose:
            print("sharpest:", ", ".join(f"{r.vid} ({r.feature:.3f})" for r in exterior.sharpest(features).collect()))
    else:
        order = ext.select("vid", F.col("vid").alias("rank"))
    both = topology.both_ways(ext_edges).join(edges, ["src", "dst"]).select("src", "dst", "len")
    return Level(vertices, edges, order.select("vid", "rank"), settle(both, "ext-both"), vertices.count(), tets=tets)


def coarser(h: Hierarchy, settings: Settings) -> Level:
    """The level above the last one, with the interpolation from it."""
    low, k = h.levels[-1], len(h.levels)
    with stage(h, k, "sampling priority"):
        rank = F.coalesce("rank", F.lit(LAST))
        order = low.vertices.select("vid").join(low.exterior.select("vid", "rank"), "vid", "left")
        order = settle(order.select("vid", rank.alias("rank"), F.col("rank").isNotNull().alias("is_exterior")), "priority")
    with stage(h, k, "sampling"):
        mean = topology.average_length(low.edges).first().avg_len
        radius = settings.search_radius_factor ** (1 / 3) * mean
        samples, marks = sampling.disk_sample(order, low.edges, radius, settings.local)
    with stage(h, k, "coarse graph"):
        clusters, coarse, ext_coarse = coarsen.exterior_first(low.vertices, samples, marks, low.exterior, low.ext_edges, low.edges)
        at = settle(samples.join(low.vertices.withColumnRenamed("vid", "fine_vid"), "fine_vid").select(F.col("coarse_id").alias("vid"), "x", "y", "z", "is_exterior"), "points")
        vertices = at.select("vid", "x", "y", "z")
        edges = settle(topology.with_length(coarse, vertices), "edges")
    with stage(h, k, "exterior detect"):
        outer = settle(at.where("is_exterior").select("vid", F.col("vid").alias("rank")), "exterior")
        ext_edges = settle(coarsen.within(ext_coarse, outer.select("vid")).join(edges, ["src", "dst"]).select("src", "dst", "len"), "ext-edges")
    with stage(h, k, "simplicial complex"):
        tris, tets = settle(cliques.triangles(coarse), "cliques3"), settle(cliques.four_cliques(coarse), "cliques4")
    with stage(h, k, "interpolation"):
        p, cases = prolong.interpolation(low.vertices, samples, clusters, coarse, tris, tets, settings.corrected)
        p = settle(p, "prolongation")
    named = tets.select(F.xxhash64("a", "b", "c", "d").alias("tid"), *[F.col(c).alias(f"v{i}") for i, c in enumerate("abcd")])
    return Level(vertices, edges, outer, ext_edges, samples.count(), named, tris, samples, clusters, p, cases)


def build(vertices: DataFrame, tets: DataFrame, settings: Settings | None = None, timing_path: str | None = None) -> Hierarchy:
    """Levels until one has at most ``min_verts`` vertices; stops early, and says so, at a level that shrinks
    by less than a hundredth. The timing document goes to ``timing_path`` if it is given, also when a level fails."""
    settings = settings or Settings()
    h = Hierarchy([])
    try:
        grow(h, vertices, tets, settings)
    finally:  # also on an early exit
        if timing_path:
            Path(timing_path).write_text(json.dumps(timing_document(h), indent=2) + "\n")
    return h


# The arrays of the timing document, an entry for each coarse level, by the stage that they tell of. Here
# coarse levels sort no features and smooth no interior, so two of them hold zeros.
LEVEL_FIELDS = {
    "level_sampling_ms": "sampling",
    "level_sampling_priority_ms": "sampling priority",
    "level_exterior_detect_ms": "exterior detect",
    "level_sort_feature_ms": "sort feature",
    "level_coarse_graph_ms": "coarse graph",
    "level_smooth_interior_ms": "smooth interior",
    "level_simplicial_complex_ms": "simplicial complex",
    "level_interpolation_ms": "interpolation",
}


def timing_document(h: Hierarchy) -> dict:
    """Milliseconds by stage, an entry for each coarse level, and in total."""
    done = {(k, name): ms for k, name, ms in h.timings}
    levels = sorted({k for k, _ in done if k})
    document = {
        "num_vertices_start": h.levels[0].n if h.levels else 0,
        "init_ms": done.get((0, "init"), 0.0),
        "init_exterior_extraction_ms": done.get((0, "finest"), 0.0),
    }
    document |= {field: [done.get((k, name), 0.0) for k in levels] for field, name in LEVEL_FIELDS.items()}
    document["level_total_ms"] = [sum(done.get((k, name), 0.0) for name in LEVEL_FIELDS.values()) for k in levels]
    return document | {"final_exterior_graph_ms": 0.0, "total_hierarchy_ms": h.total_ms}


def grow(h: Hierarchy, vertices: DataFrame, tets: DataFrame, settings: Settings) -> None:
    with stage(h, 0, "finest"):
        h.levels.append(finest(vertices, tets, settings))
    while h.levels[-1].n > settings.min_verts and len(h.levels) - 1 < settings.max_levels:
        level = coarser(h, settings)
        h.levels.append(level)
        if settings.verbose:
            print(f"level {len(h.levels) - 1}: {level.n} vertices, {h.timings[-1][2]:.0f} ms for its interpolation")
        if level.n > 0.99 * h.levels[-2].n:
            h.stopped = f"level {len(h.levels) - 1} kept {level.n} of {h.levels[-2].n} vertices"
            break


def surface(h: Hierarchy, level: int) -> DataFrame:
    """(f0, f1, f2): the surface triangles of a level, for export."""
    own = h.levels[level]
    boundary = topology.boundary_faces(own.tets)
    return boundary.select("f0", "f1", "f2") if own.triangles is None else topology.complex_surface(boundary, own.triangles)


def mapped_surface(h: Hierarchy, level: int) -> DataFrame:
    """(f0, f1, f2): the finest surface with corners moved to the nearest exterior vertex of a level."""
    faces, own = topology.boundary_faces(h.levels[0].tets), h.levels[level]
    on = h.levels[0].vertices.join(faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct(), "vid", "left_semi")
    centres = own.vertices.join(own.exterior.select("vid"), "vid", "left_semi").withColumnRenamed("vid", "coarse_id")
    return topology.remapped_surface(faces, topology.nearest_centre(on, centres))


def rotated_vertices(level: Level) -> DataFrame:
    return level.vertices.select("vid", G.render_rotation(G.point(F.col("x"), F.col("y"), F.col("z"))).alias("p")).select("vid", "p.*")
