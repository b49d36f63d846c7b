"""Helpers shared by the corpus operators: table access, Arrow column kernels and materialisation."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.storage import Scope, current, scope, settle, shared_folder

__all__ = ["Scope", "add_columns", "current", "materialise", "read_table", "scope", "settle", "shared_folder", "slices", "small_batches", "temporary", "texts", "trim", "utf8", "without"]


#: Bytes of rows that go to Python at once. The session's setting is lowered to this where nobody has changed it, since
#: Arrow buffers of whole batches stand in the JVM and in the worker at the same time.
BATCH_BYTES = 6 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", None)


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) in BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def temporary(spark: SparkSession, kind: str, name: str) -> str:
    """Enter a path or table into the scope of the run that makes it."""
    return current(spark).add(kind, name)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts the lineage and lets later stages
    restart from files any executor can reach. The run's scope deletes it unless kept."""
    if not keep:
        return settle(df, label)
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give memory that a task freed back to the system; a worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns whose names (case aside) are about to be produced."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, source: str, fields: T.StructType, make: Callable[[], Callable[[pa.Array], list]], drop_source: bool = False, size: int = 4 << 20) -> DataFrame:
    """Append ``fields``, computed from column ``source`` in runs of rows of about ``size`` bytes.

    ``make`` runs once per task and returns a function from the source's Arrow array to one Arrow array
    per field. Columns of ``df`` that clash with a new name are replaced."""
    small_batches(df.sparkSession)
    names = fields.fieldNames()
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names} and not (drop_source and c == source)]
    hidden = "__source"
    while hidden in df.columns:
        hidden += "_"
    wide = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(hidden))
    schema = T.StructType([df.schema[c] for c in kept] + list(fields.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, size):
                made = kernel(part.column(len(kept)))
                yield pa.RecordBatch.from_arrays(list(part.columns[: len(kept)]) + made, names=kept + names)
                del made
        trim()

    return wide.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of about ``size`` bytes each, so that a kernel's memory doesn't follow the
    size of batches."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def utf8(array: pa.Array) -> list[bytes]:
    """Text cells as UTF-8 bytes, null as empty, without passing through ``str``."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    return [b or b"" for b in array.cast(kind).to_pylist()]


def texts(array: pa.Array) -> list[str]:
    """Text cells as ``str``, null as empty."""
    return [t or "" for t in array.to_pylist()]
