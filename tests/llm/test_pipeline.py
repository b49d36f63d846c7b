import hashlib
import os
import re
from collections import Counter

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_bpe import LIBRARY, RANKS
from tests.llm.test_jaccard import classes

MATCH = 400


def cut(texts):
    """Each text without the bytes inside MATCH-byte strings that occur twice."""
    digest = lambda b: hashlib.blake2b(b, digest_size=12).digest()
    seen = Counter(digest(t[i : i + MATCH]) for t in texts for i in range(len(t) - MATCH + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - MATCH + 1):
            if seen[digest(t[i : i + MATCH])] > 1:
                gone[i : i + MATCH] = b"\1" * MATCH
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_run_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    rows = [r for i, (r, c) in enumerate(zip(rows, classes([r.text for r in rows]), strict=True)) if i == c]
    texts = cut([r.text.encode() for r in rows])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r, text in zip(rows, texts, strict=True):
        ids = LIBRARY[RANKS].encode_ordinary(text)
        assert (got[r.doc_id].token_ids, got[r.doc_id].n_tokens) == (ids, len(ids))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _fp int"
    rows = [(1, None, None, None, None, 1), (None, "plain words of a text here", "en", "a", 1, 2), (None, "plain words of a text here", "en", "a", 1, 2), (2, "other words, not the same at all", None, "b", 3, 4), (2, "other words, not the same at all", None, "b", 3, 4), (3, "ä" * 900, "de", None, 5, 6)]
    docs = spark.createDataFrame(rows, schema).drop("_fp")
    for docs in (docs, docs.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "tokens":
                assert docs.columns == columns
                docs = corpus_pipeline.common.materialise(docs, name, keep=True)
        got = sorted((r.doc_id or 0, r.n_tokens > 0) for r in docs.collect())
        assert got in ([(0, True), (2, True), (3, False)], [])


def test_a_run_deletes_its_own_intermediates_and_no_others(spark):
    folder = corpus_pipeline.storage.shared_folder(spark).removeprefix("file://")
    mine, other = corpus_pipeline.suffix.op2_suffix_array(spark, SF), corpus_pipeline.common.materialise(spark.range(9), "mine")
    near = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    before, tables = set(os.listdir(folder)), {t.name for t in spark.catalog.listTables()}
    made = corpus_pipeline.run(spark, SF)
    rows = made.count()
    left = {x for x in set(os.listdir(folder)) - before if not x.startswith("mixing-")}
    assert rows and not left and {t.name for t in spark.catalog.listTables()} <= tables
    assert mine.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and other.count() == 9 and near.count() >= rows


def test_language_stage_drops_only_text_of_no_learnt_language(spark):
    clean = [(i, f"{a} {b} and the other words of {a}", "en", "x", 1) for i, (a, b) in enumerate((a, b) for a in ("house", "river", "garden") for b in ("green", "old", "quiet"))]
    odd = [(50, "漢字 仮名 文章 言語 処理", "en", "x", 1), (51, "12 34 !!", None, "x", 1), (52, None, None, "x", 1)]
    docs = spark.createDataFrame(clean + [(i, t, None, s, n) for i, t, _, s, n in odd], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "nowhere").collect()}
    assert got == {r[0] for r in clean}


def moves_of_text(df) -> list[int]:
    """How many exchanges each scan of texts passes in the plan, the least first."""
    above: list[tuple[int, str]] = []
    found = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:|+\-]*", line)[0])
        above = [x for x in above if x[0] < depth]
        above.append((depth, line))
        if "Scan parquet" in line and re.search(r"[\[,]text#", line.split("Batched")[0]):
            found.append(sum(" Exchange " in f" {x.lstrip(' :|+-')}" for _, x in above))
    return sorted(found)


def test_texts_move_no_more_when_tables_are_too_large_to_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        stages = dict(corpus_pipeline.STAGES)
        got = {k: moves_of_text(stages[k](spark, docs, SF))[0] for k in ("near_duplicates", "repeats", "mixing")}
    finally:
        spark.conf.set(name, before)
    assert got == {"near_duplicates": 0, "repeats": 0, "mixing": 2}  # of the tables that the first two keep


def test_stages_pass_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some words of one text", 7, 8, 9), (2, "other words, not the same", 10, 11, 12)], "doc_id long, text string, k1 long, `a b,c;d` int, more int").withColumn("source", corpus_pipeline.F.lit("s"))
    for name in ("near_duplicates", "repeats"):
        made = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert made.columns == docs.columns and sorted(made.collect()) == sorted(docs.collect())
