"""The weighted graph of neighbouring words of a growing folder of documents, as a normalised sparse matrix.

Graph coarsening and multigrid start from a sparse symmetric matrix; this job assembles one from text and keeps it up to
date. A file stream takes only the document files that it hasn't seen (its checkpoint holds which). Each batch is
reduced to counts of word pairs, which go to ``counts`` under the number of the batch, so that a batch that is done
again replaces itself. Then ``matrix`` is assembled from the counts of all batches; texts are never read twice.

    python -m jobs.word_graph --documents /data/sf0.1 --output /data/words --config jobs/word_graph.json

``documents`` is the folder of the files, or of folders of such files as Spark writes them (those named *.parquet with
``pattern`` in front count), ``output`` gets the folders counts, matrix, mark, checkpoint and work, which is empty after a run. Settings: ``buckets``, the partitions of the matrix; ``files_per_batch``;
``pattern``. A null text has no words; a word beside itself makes no edge; documents count as often as they stand in
the files.

Entries (a, b, n, v), a < b: how often the words stand side by side, and n over the root of the product of both words'
sums of n. The matrix is symmetric and holds its upper half."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, settings
from meshframe.operators import sparse
from meshframe.storage import swept

DEFAULTS = {"buckets": 16, "files_per_batch": 64, "pattern": "documents"}
COUNTS = "i string, j string, v long, batch long"
MATRIX = "a string, b string, n long, v double, bucket int"
MARK = "batch long, buckets int"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def pairs(documents: DataFrame) -> DataFrame:
    """(i, j, v): an entry for each two different words side by side, summed up; i < j."""
    words = documents.select(F.filter(F.split("text", BLANKS), lambda w: w != "").alias("w")).where(F.size("w") > 1)
    n = F.size("w")
    beside = F.arrays_zip(F.slice("w", F.lit(1), n - 1).alias("x"), F.slice("w", F.lit(2), n - 1).alias("y"))
    both = words.select(F.inline(beside)).where("x <> y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.lit(1).cast("long").alias("v"))
    return sparse.reduce_entries(both)


def normalised(upper: DataFrame, sums: DataFrame, buckets: int) -> DataFrame:
    """The matrix of counts (i, j, v), each entry once, and of the words' sums (i, total)."""
    side = lambda k, name: sums.select(F.col("i").alias(k), F.col("total").alias(name))
    both = upper.join(side("i", "s_i"), "i").join(side("j", "s_j"), "j")
    scale = F.sqrt(F.col("s_i").cast("double")) * F.sqrt(F.col("s_j").cast("double"))
    return both.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("v").alias("n"), (F.col("v") / scale).alias("v"), F.pmod(F.crc32("i"), F.lit(buckets)).cast("int").alias("bucket"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows at ``path``, none if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written in place of what stands at ``path``, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, documents: str, output: str, buckets: int = DEFAULTS["buckets"], files_per_batch: int = DEFAULTS["files_per_batch"], pattern: str = DEFAULTS["pattern"]) -> DataFrame:
    """Take the new files of ``documents``, wait until they are done, and return the whole matrix."""
    stream = spark.readStream.schema("text string").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{documents}/{pattern}*.parquet")

    def take(batch: DataFrame, number: int) -> None:
        with settings(batch.sparkSession, spark__sql__sources__partitionOverwriteMode="dynamic"), swept(batch.sparkSession):
            pairs(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(f"{output}/counts")
        LOG.info("word_graph counted batch %s", number)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    assemble(spark, output, buckets)
    written = spark.read.schema(MATRIX).parquet(f"{output}/matrix")
    LOG.info("word_graph read %s new documents of %s; %s/matrix has %s entries", rows, documents, output, written.count())
    return written


def assemble(spark: SparkSession, output: str, buckets: int) -> None:
    """Write the matrix of all counted batches, unless the mark says that this one stands there. The mark is written
    last: a run that ends before it leaves the next one to assemble the matrix again."""
    counts = read(spark, f"{output}/counts", COUNTS)
    last = counts.agg(F.max("batch").alias("batch")).first().batch if counts is not None else None
    now = (-1 if last is None else last, buckets)
    mark = read(spark, f"{output}/mark", MARK)
    if mark is not None and [tuple(r) for r in mark.select("batch", "buckets").collect()] == [now]:
        return
    counts = spark.createDataFrame([], COUNTS) if counts is None else counts
    with settings(spark, spark__sql__sources__partitionOverwriteMode="static"), swept(spark):
        upper = kept(sparse.reduce_entries(counts.select("i", "j", "v")), f"{output}/work/entries")
        sums = kept(sparse.row_sums(upper.unionByName(sparse.transpose(upper))), f"{output}/work/sums")
        normalised(upper, sums, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/matrix")
        for part, name in ((upper, "entries"), (sums, "sums")):
            kept(spark.createDataFrame([], part.schema), f"{output}/work/{name}")  # emptied
        spark.createDataFrame([now], MARK).write.mode("overwrite").parquet(f"{output}/mark")


if __name__ == "__main__":
    command("word_graph", __doc__.split("\n")[0], {"documents": "folder of document files", "output": "folder of counts, matrix, mark and checkpoint"}, run, DEFAULTS)
