import random
import zlib

import numpy as np

from meshframe.llm import toxicity
from tests.conftest import SF


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rude = ["wretchedfool", "vilebrute", "nastycreep", "dumbwretch"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(rude) if toxic and rng.random() < 0.05 else rng.choice(plain) for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows[:400]], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = rows[400:]
    right = sum(got[i].predicted == t for i, _, t in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def area(labels, scores):
    """The share of pairs of a toxic and an ordinary document in the right order, ties by half."""
    yes, no = ([s for s, c in zip(scores, labels, strict=True) if c == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no)


def test_held_out_rows_of_the_query(spark):
    """Held-out quality at sf0.1, by labels that learning doesn't see."""
    sf = SF.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    labels = [toxic[r.doc_id] for r in rows]
    said = [c for r, c in zip(rows, labels, strict=True) if r.predicted]
    assert len(rows) > 500 and area(labels, [r.score for r in rows]) > 0.9
    assert sum(said) > 0.8 * len(said) and sum(said) > 0.6 * sum(labels)


def test_dictionaries_see_one_class_each():
    ordinary, toxic = ([w * 12 for w in ws] for ws in ([b"calm water ", b"green field "], [b"vile brute ", b"nasty creep "]))
    made = [toxicity.dictionary(x, how) for x, how in ((ordinary, toxicity.ORDINARY), (toxic, toxicity.TOXIC))]
    assert b"calm" in made[0] and b"vile" not in made[0] and b"vile" in made[1] and b"calm" not in made[1]


def test_windows_cover_the_text():
    body = b"a bb\tccc\n\nd " * 100
    assert b" ".join(toxicity.windows(body)) == b" ".join(body.split()) and toxicity.windows(b" ") == [b""]


def test_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((200, 3)), (rng.random(200) < 0.4).astype(float)
    w, centre, spread = toxicity.fit(x, y)
    a = np.c_[(x - centre) / spread, np.ones(200)]
    assert np.abs(a.T @ (1 / (1 + np.exp(-a @ w)) - y) + 0.1 * w).max() < 1e-6


def test_query(spark):
    rows = toxicity.op8_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "x " * 60_000, 0.2)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (None, 1), (3, None)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
