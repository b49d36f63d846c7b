import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meshframe.llm import suffix


def slow(texts):
    """(kept, runs) of each text by counting every window."""
    n = suffix.MATCH
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "漢字", "x", "longerword"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(50, 300)) for _ in range(5)]
    texts = [None, "", "short", "a" * 2000, "ab" * 900, say(80) * 3]
    for _ in range(n):
        t = say(rng.randint(5, 200))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += s[a : a + rng.randint(100, len(s))] + say(rng.randint(0, 60))
        texts.append(t)
    return texts + texts[-3:] + [texts[-5] + "!", "!" + texts[-6], shared[0] * 2]


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, monkeypatch, seed, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(docs, hot).collect()}
    assert got == dict(enumerate(slow([(t or "").encode() for t in texts])))


def test_small_blocks_and_segments(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    monkeypatch.setattr(suffix, "BLOCK", 900)
    texts = [t.encode() for t in corpus(3) if t]
    i, gram, at, lo, hi = suffix.anchors(texts)
    for k, t in enumerate(texts):
        mine = sorted(q for a, b in zip(lo[i == k], hi[i == k], strict=True) for q in range(a, b + 1))
        assert mine == list(range(len(t) - suffix.MATCH + 1))
    assert all(a <= p <= a + suffix.REACH and b <= p <= b + suffix.REACH for p, a, b in zip(at, lo, hi, strict=True))
    by = {}
    for k, g, p in zip(i, gram, at, strict=True):
        assert by.setdefault(texts[k][p : p + suffix.ANCHOR], g) == g
    whole = {(k, q): g for k, g, a, b in zip(i, gram, lo, hi, strict=True) for q in range(a, b + 1)}
    monkeypatch.undo()
    i, gram, _, lo, hi = suffix.anchors(texts)
    assert whole == {(k, q): g for k, g, a, b in zip(i, gram, lo, hi, strict=True) for q in range(a, b + 1)}


def test_multikey_order():
    rng = random.Random(7)
    rows = [bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(500)] + [b"a" * 24] * 3
    group = np.array([rng.randrange(3) for _ in rows])
    order, common = suffix.multikey_order(suffix.as_words(rows, 24), group)
    assert [(group[i], rows[i]) for i in order] == sorted((g, r) for g, r in zip(group, rows, strict=True))
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((j for j in range(24) if a[j] != b[j]), 24) if group[order[k]] == group[order[k - 1]] else -1
        assert common[k] == same


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "z" * 900, 5), (2, "only once " * 3, 6), (1, None, 7)], "k1 long, body string, removed int")
    rows = suffix.remove_repeats(docs, "body").collect()
    assert sorted((bytes(r.kept), [tuple(x) for x in r.removed]) for r in rows) == [(b"", []), (b"", [(0, 900)]), (b"only once " * 3, [])]
    assert suffix.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
