import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import quality


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab c\n#é\t\x0b\x85 漢"), max_size=200))
def test_base_rules(text):
    assert quality.base_row(text) == slow_base(text)
    assert quality.base_row(text + "\n" + text) == slow_base(text + "\n" + text)


def slow_mean(body, ratio):
    held = [int.from_bytes(body[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16 for i in range(len(body) - 3)]
    return sum(ratio[h] for h in held) / len(held) if held else 0.0


def test_mean_ratios():
    ratio = np.random.default_rng(3).normal(size=quality.BUCKETS)
    block = [b"", b"abc", b"abcd", b"", b"hello world" * 30, b"x" * 9, b"abc"]
    assert np.allclose(quality.mean_ratios(block, ratio), [slow_mean(b, ratio) for b in block])
    assert np.allclose(quality.mean_ratios([b"", b"a"], ratio), 0)


def test_query_against_brute_force(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}

    def counts(rows):
        out = np.zeros(quality.BUCKETS)
        for r in rows:
            b = (r.text or "").encode()
            for i in range(len(b) - 3):
                out[int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16] += 1
        return out

    trusted = [r for r in docs if r.doc_id in good]
    ratio = quality.log_ratio(counts(trusted), counts(docs))
    low = np.quantile([slow_mean((r.text or "").encode(), ratio) for r in trusted], 1 - quality.KEEP_SHARE)
    got = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        base, q = slow_base(r.text or ""), got[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base
        x = slow_mean((r.text or "").encode(), ratio)
        assert abs(q.llr - x) < 1e-9
        assert abs(x - low) < 1e-9 or q.kept == (not base[5] and x >= low)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "w " * 50_000, 5)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    ratio, threshold = quality.ratio_model(docs, labels)
    assert not ratio.any() and threshold == float("-inf")
    assert [(r.n_words, r.kept) for r in quality.rules(docs, ratio, threshold).orderBy("n_words").collect()] == [(0, False), (0, False), (50_000, False)]
    assert quality.rules(docs.limit(0), ratio, threshold).count() == 0


def test_all_good_documents_are_trusted(spark):
    """More than 20,000, and the threshold is the exact quantile of all of them."""
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality").unionByName(spark.range(5).selectExpr("id AS doc_id", "1 AS quality"))
    assert quality.trusted_texts(docs, labels).count() == n
    scores = spark.range(n).selectExpr("cast((id * 7919 % 20500) AS double) AS llr")
    assert np.isclose(quality.low_quantile(scores, "llr", 0.001), np.quantile(np.arange(n), 0.001))
    assert quality.low_quantile(scores.limit(1), "llr", 0.001) == 0.0
    assert quality.low_quantile(scores.limit(0), "llr", 0.001) is None
