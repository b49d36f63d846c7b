import random
import re

import xxhash

from meshframe.llm import simhash


def slow(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def classes(fps):
    """Smallest id by fingerprint position, comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in ["", " \t", "One", "one TWO", "É É é É", "a b c d e f a b c", "x\x0by\x0cz w q " * 50]:
        assert simhash.simhash(t.encode()) == slow(t)


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    marked = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.link(marked).collect()}
    assert got == dict(enumerate(classes(fps)))


def test_long_chain(spark):
    fps, f = [], 0
    for i in range(60):
        f ^= 1 << i % 64
        fps.append(f)
    marked = spark.createDataFrame([(100 - i, simhash.signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    assert {r.component_id for r in simhash.link(marked).collect()} == {41}


def test_query(spark):
    from tests.conftest import SF

    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, classes(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, SF).collect()} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(7, None, 1), (3, "", 2), (None, " ", 3), (9, "w " * 100_000, 4), (9, "w " * 100_000, 4)], "doc_id long, text string, fp int")
    got = simhash.link(simhash.fingerprints(docs)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (3, 3), (7, 3), (9, 9), (9, 9)]
    assert simhash.link(simhash.fingerprints(docs.limit(0))).count() == 0
