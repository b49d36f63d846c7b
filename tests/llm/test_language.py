import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import language
from tests.conftest import SF

import math  # isort: skip


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé漢ß"), min_size=1, max_size=9), max_size=8), st.integers(1, 5))
def test_gram_keys_have_every_gram(words, order):
    at, many = language.gram_keys(words, order)
    marked = [f"\x02{w}\x03" for w in words]
    assert many.tolist() == [max(0, len(w) - order + 1) for w in marked] and len(at) == many.sum()
    grams = [w[i : i + order] for w in marked for i in range(len(w) - order + 1)]
    seen = {}
    for g, b in zip(grams, at.tolist(), strict=True):
        assert seen.setdefault(g, b) == b
    assert len(set(seen.values())) == len(seen)


def split(word, order):
    marked = f"\x02{word}\x03"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def slow_scores(rows, text, vocabulary=language.VOCABULARY):
    """The scores by plain dictionaries of words and n-grams."""
    langs = sorted({x for _, x in rows if x is not None})
    words = {x: {} for x in langs}
    for t, x in rows:
        for w in language.words_of(t or "") if x is not None else ():
            words[x][w] = words[x].get(w, 0) + 1
    known = {w for x in langs for w in words[x]}
    grams = {(x, o): {} for x in langs for o in language.ORDERS}
    for x in langs:
        for w, n in words[x].items():
            for o in language.ORDERS:
                for b in split(w, o):
                    grams[x, o][b] = grams[x, o].get(b, 0) + n
    total = dict.fromkeys(langs, 0.0)
    s = language.SMOOTH
    for w in language.words_of(text):
        if w in known:
            for x in langs:
                total[x] += math.log((words[x].get(w, 0) + s) / (sum(words[x].values()) + s * len(known)))
            continue
        for o in language.ORDERS:
            hit = [b for b in split(w, o) if any(b in grams[x, o] for x in langs)]
            if hit:
                for x in langs:
                    total[x] += sum(math.log((grams[x, o].get(b, 0) + s) / (sum(grams[x, o].values()) + s * len({g for y in langs for g in grams[y, o]}))) for b in hit) / len(hit)
                break
    best = max(total.values())
    return {x: math.exp(v - best) / sum(math.exp(u - best) for u in total.values()) for x, v in total.items()}


def test_against_plain_dictionaries(spark):
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("die Katze ist auf der Matte", "de"), (None, "en"), ("ignored words", None)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the mat", "chaton sur", "Katzen und Matten", "zzz qqq", "The the LE der", "tapistes ²"]
    got = {r.text: r for r in language.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for t in texts:
        want = slow_scores(rows, t)
        assert abs(got[t].score - max(want.values())) < 1e-4 and abs(want[got[t].lang_pred] - max(want.values())) < 1e-4


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in language.op7_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out and d.lang]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 2), (3, "123 ... ½", "en", 3), (None, "word " * 30_000, "en", 4), (5, "word", "en", 5)], "doc_id long, text string, lang string, score int")
    model = language.learn(docs)
    got = language.predict(docs, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("en", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0), ("en", 1.0)]
    none = language.learn(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none).collect()} == {("und", 0.0)} and language.predict(docs.limit(0), none).count() == 0


def test_backoff_reaches_every_order(spark):
    """A word without a known n-gram of an order is told by the next shorter one, and by exactly that."""
    rows = [("abcdefgh abcdefgh mnop", "aa"), ("stuvwxyz", "bb")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    for word, order in (("zzcdefgzz", 5), ("zzcdefzz", 4), ("qqcdeqq", 3), ("qqcdqq", 2), ("qqcqq", 1), ("abcdefgh", 0)):
        hit = next((o for o in language.ORDERS if any(language.gram_keys([word], o)[0][i] in model.grams[o].keys for i in range(len(language.gram_keys([word], o)[0])))), None)
        assert order == 0 or hit == order, (word, hit)
        want = slow_scores(rows, word)
        got = language.Scorer(model)([word])[0]
        assert got[0] == max(want, key=want.get) and abs(got[1] - max(want.values())) < 1e-5
        assert got[2] == (order != 1)
    assert language.Scorer(model)(["漢字"])[0][2] == 0


def test_unseen_grams_stay_unknown_in_a_large_model(spark):
    """Of 40,000 counted words' n-grams none stands for one that wasn't counted."""
    import random

    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(9)) for _ in range(40_000))
    model = language.learn(spark.createDataFrame([(text, "aa")], "text string, lang string"))
    other = ["".join(rng.choice("nopqrstuvwxyz") for _ in range(9)) for _ in range(3000)]
    for o in (5, 4, 3):
        assert (model.grams[o].find(language.gram_keys(other, o)[0]) < 0).all()


def test_fifty_languages_take_memory_in_proportion(spark):
    def made(n):
        rows = [(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) + " shared words of all", f"l{k:02d}") for k in range(n)]
        model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
        return model.words.nbytes + sum(t.nbytes for t in model.grams.values())

    assert made(50) < 5.5 * made(10)
