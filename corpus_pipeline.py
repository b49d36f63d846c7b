"""From raw documents to token ids: language ID, near-duplicate removal, removal of long repeats, mixing of
sources and byte-level BPE. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents; all but the last return the columns of documents.
A stage begins by deleting the intermediate files of the stage before it on the same tables, whose result is written by
then; nothing else is touched, and ``run`` also deletes the written result once the next one stands.

* ``language`` drops documents without letters, those whose best language scores under MIN_SCORE, and those in which
  fewer than MIN_EVIDENCE of the words have anything that the learnt languages have.
* ``near_duplicates`` keeps the document with the smallest doc_id of each component of texts whose five-word shingles
  have a Jaccard similarity of 0.8 or more.
* ``repeats`` removes every byte inside a 400-byte string that occurs twice; a character cut by an edge goes.
* ``mixing`` puts the documents in the order of the mix: files and rows follow its slots.
* ``tokens`` encodes and decodes the texts and returns the ids.

Defined results: null and empty texts have no letters and go with ``language``; a text of any length is handled whole;
a null lang is never learnt from, a null source is the source ''; of equal or similar texts the smallest doc_id stays,
null ids last, and of rows with equal ids one; a text that repeats remove entirely stays as an empty one; an empty table
gives an empty table; further columns are passed on up to ``tokens``, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe import storage
from meshframe.llm import bpe, common, jaccard, language, mixing, suffix

MIN_SCORE, MIN_EVIDENCE = 0.25, 0.5
RANKS = "byte_bpe_50k.tiktoken"
#: The intermediate results of the stage that ran last, by application and tables.
LAST: dict[tuple[str, str], storage.Scope] = {}


@contextmanager
def stage_scope(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Iterator[None]:
    common.small_batches(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    before = LAST.pop(key, None)
    with storage.scope(spark) as own:
        if before:
            files = docs.inputFiles()
            if not files or any(f.startswith(sf_dir) or sf_dir in f or any(name in f for _, name in before.made) for f in files):
                storage.LASTING.setdefault(key[0], storage.Scope(spark)).made.extend(before.made)  # may still be read
            else:
                before.close()
        LAST[key] = own
        yield


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_scope(spark, docs, sf_dir):
        added = ("lang_pred", "score", "evidence")
        aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in added}
        marked = language.predict(docs.withColumnsRenamed(aside), language.learn(docs), evidence=True)
        kept = marked.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("evidence") >= MIN_EVIDENCE))
        return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_scope(spark, docs, sf_dir):
        aside = {c: f"_own{c}" for c in docs.columns if c.lower() in ("_row", "_key", "_bands", "_size", "_root")}
        numbered = docs.withColumnsRenamed(aside).withColumn("_row", F.monotonically_increasing_id())
        signed = jaccard.signatures(numbered)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        marked = storage.bucketed(signed.repartition(parts, "_row"), "_row", "near-duplicates")[0]  # later joins on _row move no text
        grouped = jaccard.link(marked)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("one")
        winners = grouped.groupBy("_root").agg(first).select("one._row")
        return marked.join(winners, "_row", "left_semi").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_scope(spark, docs, sf_dir):
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_own")
        rows = docs.select(own, *[k.alias(n) for n, k in suffix.key_columns().items()])
        kept = suffix.as_text(suffix.cut(suffix.distinct_texts(docs), rows=rows), "kept", "_kept")
        made = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
        return kept.select(*[made.get(c, F.col("_own")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_scope(spark, docs, sf_dir):
        return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with stage_scope(spark, docs, sf_dir):
        ranks = public_tokenizers.path(RANKS)
        ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, drop_text=True)
        back = bpe.decode(ids, ranks)
        return back.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeat_stage), ("mixing", mixing_stage), ("tokens", token_stage)]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = storage.settled(docs, name)
            if held:
                storage.forget(spark, held)
            held = path
    return docs
