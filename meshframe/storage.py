"""Where iterations cut their lineage: Parquet in the folder that the cluster shares.

Intermediate results belong to a scope. ``with scope(spark) as own:`` gathers those made inside, and ``own.close()``
deletes them once the results that read them are written; no scope touches what another made. What is made outside of
any scope lasts as long as the application and is deleted at its end."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a local folder is made, which only a session
    whose executors are threads of this process can share; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="meshframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: MB of shuffled ids that one task of a graph's step gets: they grow some 35-fold in its hash tables and sorts.
ADVISORY, ADVISORY_DEFAULT = "16MB", ("67108864b", "64MB", None)


def small_partitions(spark: SparkSession) -> None:
    """Lower the size at which AQE merges shuffle partitions, where it stands at its default, and leave it so: plans run
    after they are made."""
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) in ADVISORY_DEFAULT:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISORY)


#: Spark's setting by which a query's shuffle files go when it has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they are of no use after, since what reads the result reads its files.
    The setting is put back, because a result that is collected twice keeps its shuffles."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scope:
    """The intermediate files and tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[tuple[str, str]] = []

    def add(self, kind: str, name: str) -> str:
        self.made.append((kind, name))
        return name

    def drop(self, name: str) -> None:
        """Delete one of them now; names of other scopes are left alone."""
        for kind, own in [x for x in self.made if x[1] == name]:
            self.made.remove((kind, own))
            if kind == "table":
                self.spark.sql(f"DROP TABLE IF EXISTS {own}")
            else:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(own)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for _, name in list(self.made):
            self.drop(name)


ACTIVE: ContextVar[Scope | None] = ContextVar("meshframe scope", default=None)
#: The scope of what is made outside of any other, by application.
LASTING: dict[str, Scope] = {}


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    own = Scope(spark)
    before = ACTIVE.set(own)
    try:
        yield own
    finally:
        ACTIVE.reset(before)


def current(spark: SparkSession) -> Scope:
    if (own := ACTIVE.get()) is not None and own.spark.sparkContext is spark.sparkContext:
        return own
    return LASTING.setdefault(spark.sparkContext.applicationId, Scope(spark))


@atexit.register
def at_the_end() -> None:
    for own in LASTING.values():
        try:
            own.close()
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` computed once, written to the shared folder and read back; survives lost executors."""
    return settled(df, label)[0]


def settled(df: DataFrame, label: str = "step") -> tuple[DataFrame, str]:
    """``settle`` and the path, by which ``forget`` deletes it before its scope ends."""
    spark = df.sparkSession
    path = current(spark).add("path", f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, key: str, label: str = "table") -> tuple[DataFrame, tuple[str, str]]:
    """``df`` written as a table in the shared folder whose files are the shuffle partitions of ``key``, so that joins
    on it need no exchange; with the names for ``forget``."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    own = current(spark)
    name, path = own.add("table", f"meshframe_{label}_{mark}".replace("-", "_")), own.add("path", f"{shared_folder(spark)}/{label}-{mark}")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with swept(spark):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name), (name, path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete settled results that nothing reads any more."""
    for path in paths:
        current(spark).drop(path)
