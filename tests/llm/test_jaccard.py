import random

import pytest

import corpus_pipeline
from meshframe.llm import jaccard
from tests.conftest import SF


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts):
    """Smallest place of each component, comparing all pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("members", [jaccard.MEMBERS, 2])
def test_stage_removes_copies_of_similarity_08(spark, monkeypatch, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    rng = random.Random(3)
    texts = ["", "one two", "One  two", "one two three"]
    for _ in range(12):
        words = [str(rng.randrange(10**6)) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 12)):
            words = list(words)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = str(rng.randrange(10**6))
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    want = [i for i, c in enumerate(classes(texts)) if i == c]
    assert got == want and len(want) < len(texts)


def test_parts_of_a_large_bucket_find_every_link(spark, monkeypatch):
    """Near copies that all meet in one bucket, in chains whose ends differ: parts of two texts or of few bytes find the
    components of all pairs, and no task gets more."""
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        words = [str(rng.randrange(10**6)) for _ in range(120)]
        for _ in range(9):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(120)] = str(rng.randrange(10**6))
    rng.shuffle(texts)
    want = classes(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, text string")
    marked = jaccard.materialise(jaccard.signatures(docs).withColumn("_bands", jaccard.F.array(jaccard.F.lit(1).cast("long"))), "one-bucket")
    for name, value in (("MEMBERS", 2), ("SET_BYTES", 1_500)):
        with monkeypatch.context() as m:
            m.setattr(jaccard, name, value)
            got = {r._row: r._root for r in jaccard.link(marked).collect()}
        firsts = {}
        assert [firsts.setdefault(got[i], i) for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_tables_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {r.doc_id for i, (r, c) in enumerate(zip(rows, classes([r.text or "" for r in rows]), strict=True)) if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == want


def test_a_bridge_joins_groups():
    base = list(range(0, 200))
    near = [jaccard.np.array(sorted(x), jaccard.np.uint64) for x in (base, [*base[:180], *range(500, 520)], [*base[:160], *range(500, 540)])]
    assert not jaccard.similar(near[0], near[2])
    assert [sorted(g) for g in jaccard.grouped([near[0], near[2], near[1]])] == [[0, 1, 2]]
