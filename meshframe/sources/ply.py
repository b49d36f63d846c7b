"""Tetrahedral PLY files as tables: a Spark data source that reads byte ranges and writes parts in parallel, and writers
of single files.

Paths with a scheme (file://, hdfs://, s3://) go through Arrow's file systems, on the driver and in tasks alike; plain
paths are local. A file in parts is a header, a part for each task's vertices and tetrahedra, in order, and the listing
that ``sources.parts`` puts together; it can be read as it is.

Binary files are little endian: float32 x, y, z per vertex, then a count byte (4) and four int32 per tet.
Text files have the same values as lines. Ids are positions."""

from __future__ import annotations

import argparse
import io
import json
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from meshframe import schema
from meshframe.sources import parts as assembly

VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
TET = np.dtype([("n", "u1"), ("v", "<i4", 4)])
#: Rows of one partition.
ROWS = 1_000_000
#: Rows that are packed at once when a file is written.
BLOCK = 65_536


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str) -> BinaryIO:
    """A file to read from, with a buffer, for lines and for seeking."""
    system, at = store(path)
    return io.BufferedReader(system.open_input_file(at))


def exists(path: str) -> bool:
    system, at = store(path)
    return system.get_file_info(at).type == fs.FileType.File


@dataclass
class Header:
    text: bool
    vertices: int
    tets: int
    size: int


def read_header(path: str) -> Header:
    """The header; big-endian files, and vertices with properties after x, y and z, raise."""
    kind, counts, properties, element = "", {"vertex": 0, "face": 0}, [], ""
    with opened(path) as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        while (line := f.readline()) and line.strip() != b"end_header":
            words = line.decode("ascii").split()
            if words[:1] == ["format"]:
                kind = words[1]
            elif words[:1] == ["element"]:
                element = words[1]
                counts[element] = int(words[2])
            elif words[:1] == ["property"] and element == "vertex":
                properties.append(words[-1])
        size = f.tell()
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"{path} has the format {kind!r}")
    if kind != "ascii" and properties != ["x", "y", "z"]:
        raise ValueError(f"{path} has the vertex properties {properties}")
    return Header(kind == "ascii", counts["vertex"], counts["face"], size)


@dataclass
class Rows(InputPartition):
    path: str
    start: int  #: bytes before the first row
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int
    last: int
    count: int


def kind_of(element: str) -> np.dtype:
    return VERTEX if element == "vertices" else TET


def listing(folder: str, name: str, element: str) -> str:
    return f"{folder.rstrip('/')}/{name}.{element}.json"


class TetPlyReader(DataSourceReader):
    """A file, or with ``name`` the parts of that name in a folder."""

    def __init__(self, path: str, element: str, rows: int = ROWS, name: str | None = None):
        self.path, self.element, self.rows, self.name = path, element, rows, name

    def partitions(self) -> list[Rows]:
        kind = kind_of(self.element)
        if self.name:
            with opened(listing(self.path, self.name, self.element)) as f:
                parts = [(f"{self.path.rstrip('/')}/{p['file']}", 0, p["first"], p["count"]) for p in json.load(f)]
        else:
            header = read_header(self.path)
            skip = header.size + (0 if self.element == "vertices" else header.vertices * VERTEX.itemsize)
            parts = [(self.path, skip, 0, header.vertices if self.element == "vertices" else header.tets)]
        cut = [Rows(path, start + k * kind.itemsize, first + k, min(self.rows, n - k)) for path, start, first, n in parts for k in range(0, n, self.rows)]
        return cut or [Rows(self.path, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kind = kind_of(self.element)
        if not partition.count:
            return
        with opened(partition.path) as f:
            f.seek(partition.start)
            got = np.frombuffer(f.read(partition.count * kind.itemsize), kind)
        if len(got) != partition.count:
            raise ValueError(f"{partition.path} ends early")
        ids = pa.array(np.arange(partition.first, partition.first + partition.count))
        if self.element == "vertices":
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[a].astype(float)) for a in "xyz")], names=["vid", "x", "y", "z"])
            return
        if (got["n"] != 4).any():
            raise ValueError(f"{partition.path} has faces that aren't tetrahedra")
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(got["v"][:, k].astype(np.int64)) for k in range(4))], names=["tid", "v0", "v1", "v2", "v3"])


class TetPlyWriter(DataSourceArrowWriter):
    """Each task writes a part of its own; the listing names those that count, once all are there."""

    def __init__(self, folder: str, name: str, element: str):
        self.folder, self.name, self.element, self.run = folder.rstrip("/"), name, element, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        file = f"{self.name}.{self.element}-{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, at = store(f"{self.folder}/{file}")
        first, last, count = -1, -1, 0
        with system.open_output_stream(at) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                if (np.diff(ids) != 1).any() or count and ids[0] != last + 1:
                    raise ValueError(f"{self.element} must be sorted, with ids that follow each other")
                rows = np.zeros(len(ids), kind_of(self.element))
                if self.element == "vertices":
                    rows["x"], rows["y"], rows["z"] = columns
                else:
                    rows["n"], rows["v"] = 4, np.column_stack(columns)
                out.write(rows.tobytes())
                first, last, count = (first if count else int(ids[0])), int(ids[-1]), count + len(ids)
        return Written(file, first, last, count)

    def commit(self, messages: list[Written]) -> None:
        parts = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        if [m.first for m in parts] != [0, *(m.last + 1 for m in parts)][: len(parts)]:
            self.abort(messages)
            raise ValueError(f"the ids of {self.element} don't count from 0")
        system, at = store(listing(self.folder, self.name, self.element))
        with system.open_output_stream(at) as out:
            out.write(json.dumps([{"file": m.file, "first": m.first, "count": m.count} for m in parts]).encode())

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            if m is not None:
                system, at = store(f"{self.folder}/{m.file}")
                system.delete_file(at)


class TetPly(DataSource):
    """``spark.read.format("tetply").option("element", "vertices" | "tets").load(path)``, binary files; the
    option ``rows`` sets the rows of a partition. With the option ``name`` the path is a folder that holds the parts of
    that name, and rows in order of their ids can be written there."""

    @classmethod
    def name(cls) -> str:
        return "tetply"

    def schema(self):
        return schema.VERTICES if self.options.get("element", "vertices") == "vertices" else schema.TETS

    def reader(self, schema) -> TetPlyReader:
        return TetPlyReader(self.options["path"], self.options.get("element", "vertices"), int(self.options.get("rows", ROWS)), self.options.get("name"))

    def writer(self, schema, overwrite: bool) -> TetPlyWriter:
        return TetPlyWriter(self.options["path"], self.options["name"], self.options.get("element", "vertices"))


def write_parts(folder: str, name: str, vertices: DataFrame, tets: DataFrame) -> dict:
    """A binary file in parts, written by the tasks that hold the rows; ids must count from 0. Returns the manifest entry
    (filename, size, parts) from which ``sources.parts`` makes one file. A part is written whole by one attempt of one
    task, and only attempts that succeeded are listed."""
    spark = vertices.sparkSession
    spark.dataSource.register(TetPly)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, at = store(folder)
    system.create_dir(at)
    for df, key, element, kind in ((vertices, "vid", "vertices", schema.VERTICES), (tets, "tid", "tets", schema.TETS)):
        dealt = df.select(*kind.fieldNames()).repartitionByRange(parts, key).sortWithinPartitions(key)
        dealt.write.format("tetply").option("element", element).option("name", name).mode("append").save(folder)
    listed = []
    for element in ("vertices", "tets"):
        with opened(listing(folder, name, element)) as f:
            listed.append(json.load(f))
    n, m = (sum(p["count"] for p in x) for x in listed)
    head = header_of(n, m)
    system, at = store(f"{folder.rstrip('/')}/{name}.header")
    with system.open_output_stream(at) as out:
        out.write(head)
    size = len(head) + n * VERTEX.itemsize + m * TET.itemsize
    return {"filename": f"{name}.ply", "size": size, "parts": [f"{name}.header", *(p["file"] for x in listed for p in x)]}


def read_parts(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a file in parts."""
    spark.dataSource.register(TetPly)
    return tuple(spark.read.format("tetply").option("element", e).option("name", name).load(folder) for e in ("vertices", "tets"))


def header_of(n: int, m: int) -> bytes:
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nelement face {m}\nproperty list uchar int vertex_indices\nend_header\n".encode()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, k): the lines of one file from 0. A file's splits are its partitions in order, so a line's number is its
    place in the partition after the lines of those before; these are counted first, a number a partition."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    marked = rows.select("line", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("row"))
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return marked.join(F.broadcast(base), "part").select("line", (F.col("base") + F.col("row")).alias("k"))


def text_rows(spark: SparkSession, path: str, element: str, header: Header) -> DataFrame:
    """The lines of a text file's element."""
    lines = sum(1 for _ in _header_lines(path))
    rows = numbered_lines(spark, path)
    cells = F.split(F.trim("line"), r"\s+")
    first = lines if element == "vertices" else lines + header.vertices
    n = header.vertices if element == "vertices" else header.tets
    inside = (F.col("k") >= first) & (F.col("k") < first + n)
    # only lines inside are taken apart, also where a condition on the values moves ahead of the numbering
    own = rows.where(inside).select((F.col("k") - first).alias("id"), F.when(inside, cells).alias("c"))
    if element == "vertices":
        return own.select(F.col("id").alias("vid"), *[F.col("c")[i].cast("float").cast("double").alias(a) for i, a in enumerate("xyz")])
    checked = F.when(F.col("c")[0] != "4", F.raise_error(F.lit("a face isn't a tetrahedron"))).otherwise(F.col("c")[1])
    return own.select(F.col("id").alias("tid"), checked.cast("bigint").alias("v0"), *[F.col("c")[i + 1].cast("bigint").alias(f"v{i}") for i in (1, 2, 3)])


def _header_lines(path: str) -> Iterator[bytes]:
    with opened(path) as f:
        for line in f:
            yield line
            if line.strip() == b"end_header":
                return


def read_element(spark: SparkSession, path: str, element: str) -> DataFrame:
    if not exists(path):
        raise FileNotFoundError(f"{path} is missing; assemble it from its parts with sources.parts")
    header = read_header(path)
    if header.text:
        return text_rows(spark, path, element, header)
    spark.dataSource.register(TetPly)
    return spark.read.format("tetply").option("element", element).load(path)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return read_element(spark, path, "vertices")


def read_tets(spark: SparkSession, path: str) -> DataFrame:
    return read_element(spark, path, "tets")


def read_mesh(spark: SparkSession, path: str, parts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a file; a missing one is put together first if folder ``parts`` has its parts."""
    if parts and not os.path.exists(path):
        assembly.ensure(path, parts)
    return read_vertices(spark, path), read_tets(spark, path)


def import_tetgen(spark: SparkSession, source: str, target: str) -> bool:
    """A text mesh checked and rewritten as binary; False where the source is missing."""
    if not os.path.exists(source):
        return False
    v, t = read_mesh(spark, source)
    header = read_header(source)
    if (bad := v.where(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).count()) or v.count() != header.vertices:
        raise ValueError(f"{source}: {bad} vertices without three coordinates, {header.vertices} expected in all")
    if t.where(" or ".join(f"v{i} is null or v{i} < 0 or v{i} >= {header.vertices}" for i in range(4))).count() or t.count() != header.tets:
        raise ValueError(f"{source}: tetrahedra that don't name four vertices, or not {header.tets} of them")
    write_tet_ply(target, v, t)
    return True


def import_all(spark: SparkSession, source: str, target: str, names: dict[str, str]) -> dict[str, bool]:
    """Import each file of ``names`` (source name: target name) that is there; which were."""
    os.makedirs(target, exist_ok=True)
    return {old: import_tetgen(spark, os.path.join(source, old), os.path.join(target, new)) for old, new in names.items()}


def main(argv: list[str] | None = None) -> int:
    """``python -m meshframe.sources.ply --source DIR --target DIR old.ply=new.ply ...``; the source folder may come from
    MESHFRAME_SOURCE."""
    parser = argparse.ArgumentParser(description="Import text meshes as binary files.")
    parser.add_argument("names", nargs="+", help="old.ply=new.ply")
    parser.add_argument("--source", default=os.environ.get("MESHFRAME_SOURCE"))
    parser.add_argument("--target", default=".")
    args = parser.parse_args(argv)
    if not args.source:
        parser.error("--source or MESHFRAME_SOURCE is needed")
    done = import_all(SparkSession.builder.appName("import").getOrCreate(), args.source, args.target, dict(n.split("=", 1) for n in args.names))
    for name, was_there in done.items():
        print(f"{name}: {'imported' if was_there else 'skipped, missing'}")
    return 0 if any(done.values()) else 1


def batched(rows: Iterator, n: int) -> Iterator[list]:
    rows = iter(rows)
    while block := list(islice(rows, n)):
        yield block


def write_tet_ply(path: str, vertices: DataFrame, tets: DataFrame) -> None:
    """One local binary file, in the order of the ids, which must count from 0. Rows stream through the driver;
    ``write_parts`` is the form for large meshes."""
    n, m = vertices.count(), tets.count()
    with open(f"{path}.tmp", "wb") as f:
        f.write(header_of(n, m))
        for rows in batched(map(tuple, vertices.orderBy("vid").select("x", "y", "z").toLocalIterator()), BLOCK):
            f.write(np.array(rows, VERTEX).tobytes())
        for rows in batched(((4, tuple(r)) for r in tets.orderBy("tid").select("v0", "v1", "v2", "v3").toLocalIterator()), BLOCK):
            f.write(np.array(rows, TET).tobytes())
    os.replace(f"{path}.tmp", path)


def write_surface_ply(path: str, vertices: DataFrame, faces: DataFrame, depth: DataFrame) -> None:
    """A text file of vertices with a depth and triangles; without triangles it has no face section. Ids are
    renumbered by their order."""
    points = [(r.vid, r.x, r.y, r.z, r.depth) for r in vertices.join(depth, "vid").orderBy("vid").toLocalIterator()]
    place = {p[0]: k for k, p in enumerate(points)}
    tris = [tuple(place[x] for x in r) for r in faces.select("f0", "f1", "f2").toLocalIterator()]
    with open(path, "w", newline="\n") as f:
        f.write(f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nproperty int depth\n")
        if tris:
            f.write(f"element face {len(tris)}\nproperty list uchar int vertex_indices\n")
        f.write("end_header\n")
        f.writelines("%.6g %.6g %.6g %d\n" % p[1:] for p in points)
        f.writelines("3 %d %d %d\n" % t for t in tris)


if __name__ == "__main__":
    sys.exit(main())
