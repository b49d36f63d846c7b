"""Quality rules with a hashed n-gram log-likelihood ratio (operator 4).

``base_rules`` counts words, symbols, repeated lines and repeated 8-word windows. ``ratio_model`` estimates
two multinomials over hashed byte n-grams, one of a trusted target (all documents labelled good), one of the whole raw corpus; a document's score is its mean log ratio per n-gram, and it is kept if
the score reaches a threshold that a fixed share of the trusted documents reach. Nothing is random: every
document is scored whole, and the same tables always give the same verdicts.

Defined results: null and empty texts have no words, score 0 and fail the base rules; a text shorter than
an n-gram scores 0; without trusted documents the ratio is 0 everywhere and the base rules decide; repeated
rows repeat their result; an empty table gives an empty table; clashing columns are replaced."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read_table, slices, texts, utf8

GRAM, BUCKETS = 4, 1 << 16
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The share of the trusted documents to keep.
KEEP_SHARE = 0.999
#: Pseudo-count of each bucket.
SMOOTH = 0.5
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())])


def repeated_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that occur twice or more in the text."""
    import xxhash

    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window += h[i : n - WINDOW + 1 + i]
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def base_row(text: str) -> tuple:
    body = text.encode()
    words = body.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if "\n" in text else []
    repeats = repeated_words(words)
    n = len(words)
    return n, len(text) - sum(map(text.count, BLANKS)), len(body) - len(body.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n


def buckets(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of a block of texts, and how many each text has."""
    counts = np.array([max(0, len(b) - GRAM + 1) for b in block], np.int64)
    body = np.frombuffer(b"".join(b for b, n in zip(block, counts, strict=True) if n) + b"\0" * 8, np.uint8)
    words = np.ndarray((len(body) - 8,), "<u4", body, 0, (1,))
    if not counts.sum():
        return np.empty(0, np.int64), counts
    ends = np.cumsum(counts[counts > 0] + GRAM - 1)
    inside = np.ones(len(words), bool)
    for i in range(1, GRAM):
        inside[ends - i] = False
    h = words[inside].astype(np.uint32) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64), counts


def blocks(items: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    at, held = 0, 0
    for i, b in enumerate(items):
        held += len(b)
        if held > size:
            yield items[at : i + 1]
            at, held = i + 1, 0
    yield items[at:]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all n-grams of the corpus: a fixed number of counters a task, then sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in (part for b in batches for part in slices(b)):
            for block in blocks(utf8(batch.column(0))):
                total += np.bincount(buckets(block)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def table(counts: DataFrame) -> np.ndarray:
    """The counters as an array; there are BUCKETS of them whatever the corpus."""
    out = np.zeros(BUCKETS)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not trusted.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)
    return np.log(share(trusted) / share(raw))


def mean_ratios(block: list[bytes], ratio: np.ndarray) -> np.ndarray:
    held, counts = buckets(block)
    sums = np.concatenate([[0.0], np.cumsum(ratio[held])])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


def score(df: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``llr`` double, the mean log ratio per n-gram."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def make() -> Callable:
        return lambda column: [pa.array(np.concatenate([mean_ratios(b, shared.value) for b in blocks(utf8(column))]))]

    return add_columns(df, text_col, T.StructType([T.StructField("llr", T.DoubleType())]), make)


def rules(df: DataFrame, ratio: np.ndarray, threshold: float, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts, ``llr`` and ``kept`` in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def make() -> Callable:
        def kernel(column: pa.Array) -> list:
            whole = texts(column)
            base = list(zip(*map(base_row, whole), strict=True)) or [()] * 6
            llr = np.concatenate([mean_ratios(b, shared.value) for b in blocks([t.encode() for t in whole])])
            kept = (llr >= threshold) & ~np.array(base[5], bool)
            return [*(pa.array(c, pa.int64()) for c in base[:5]), pa.array(base[5], pa.bool_()), pa.array(llr), pa.array(kept)]

        return kernel

    return add_columns(df, text_col, T.StructType([*BASE.fields, T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())]), make, drop_source=True)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of all documents labelled good."""
    ids = labels.where("quality = 1").select("doc_id").distinct()
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")  # the texts are not shuffled


def low_quantile(scores: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, interpolated, of a small ``share``; None without rows. A task keeps no more than that share."""
    at = (scores.count() - 1) * share
    if at < 0:
        return None
    low = int(at)
    near = [r[0] for r in scores.select(column).orderBy(column).offset(low).limit(2).collect()]
    return float(near[0] if len(near) == 1 else (low + 1 - at) * near[0] + (at - low) * near[1])


def ratio_model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket and the threshold of the mean."""
    trusted = trusted_texts(docs, labels)
    ratio = log_ratio(table(gram_counts(trusted)), table(gram_counts(docs)))
    low = low_quantile(score(trusted, ratio), "llr", 1 - KEEP_SHARE)
    return ratio, float("-inf") if low is None else low


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio, threshold = ratio_model(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    made = rules(docs, ratio, threshold)
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
