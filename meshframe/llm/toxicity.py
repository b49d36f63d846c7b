"""Toxicity by compression distance (operator 8).

Two zstandard dictionaries are trained, one on ordinary text, a small one on toxic text, neither with a look at the
other class. Every window of WINDOW words of the whole text is compressed twice, by the ordinary dictionary and by the
toxic one followed by the ordinary one; the second is shorter where the window holds what is common in toxic text and
not in ordinary text. (Against the toxic dictionary alone, chance matches of ordinary text drown the difference.) Both
serve as plain content, without entropy tables. The differences of the lengths, as counts over thresholds, are
calibrated by logistic regression on labelled documents that the dictionaries in use haven't seen: ordinary ones of
the half that isn't trained on, toxic ones by a dictionary trained on the other FOLDS - 1 parts.

Learning takes a bounded sample of labelled rows (SAMPLE per class, SAMPLE_BYTES of text); scores cover all
windows. Defined results: null and empty texts are one empty window; texts of any length are scored whole; where only
one class is labelled every score is that class's, all but 1e-13 of 1 or 0, and 0 in the same way where none is; repeated
rows repeat their score; an empty table gives an empty table; columns that clash with the output are replaced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, read_table, utf8

WINDOW = 16
#: Labelled rows to learn from, at most, per class, and their bytes on the driver.
SAMPLE = 6_000
SAMPLE_BYTES = 96 << 20
#: Of each dictionary: its size at most, the share of the text trained on that it may take, and the segment and string
#: lengths of its training.
ORDINARY, TOXIC = (800_000, 1 / 9, 200, 8), (16_384, 1 / 100, 20, 8)
#: Odds of a toxic document that the scores assume, over those of the labelled rows, as a miss weighs more than an alarm.
ODDS = 1 / 4
#: Parts of the toxic sample, each measured by a dictionary of the others.
FOLDS = 4
#: Words of a training sample.
PIECE = 60
OVER, UNDER = (1, 2, 3, 4, 5, 7), (1, 2, 4)
WIDTH = 4 + len(OVER) + len(UNDER)
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def windows(body: bytes, size: int = WINDOW) -> list[bytes]:
    words = body.split()
    return [b" ".join(words[i : i + size]) for i in range(0, max(1, len(words)), size)]


def train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    import zstandard

    held = [s for s in samples if len(s) > 7]
    try:
        return zstandard.train_dictionary(size, held, k=k, d=d).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(held)[:size]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def compressors(self) -> list:
        import zstandard as z

        how = z.ZstdCompressionParameters(window_log=20, chain_log=19, hash_log=20, search_log=6, min_match=5, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = [z.ZstdCompressionDict(b or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT) for b in (self.ordinary, self.toxic + self.ordinary)]
        return [z.ZstdCompressor(dict_data=d, compression_params=how).compress for d in made]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def distances(body: bytes, ordinary: Callable, toxic: Callable) -> list[float]:
    """The features of one text from the differences of its windows' lengths."""
    d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(body)], float)
    n = len(d)
    return [d.mean(), d.max(), d.sum() / n**0.5, *((d >= q).mean() for q in OVER), *((d <= -q).mean() for q in UNDER), 1 / n]


def dictionary(bodies: list[bytes], how: tuple[int, float, int, int], whole: int | None = None) -> bytes:
    """A dictionary of texts, of the size that ``whole`` bytes of text would have."""
    most, share, k, d = how
    size = max(2_048, min(most, int(share * (whole or sum(map(len, bodies))))))
    return train([p for body in bodies for p in windows(body, PIECE)], size, k, d)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with a small ridge, by Newton's method."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - centre) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, spread


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(key, text, toxic) of at most ``most`` labelled rows a class, the first by a hash of their id."""
    key = F.xxhash64("doc_id")
    of = lambda c: labels.where(F.col("toxic") == c).select("doc_id", "toxic").distinct().orderBy(key, "doc_id").limit(most)
    ids = of(0).unionByName(of(1)).where(F.col("doc_id").isNotNull())
    return materialise(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(key.alias("key"), "text", "toxic"), "labelled")


def measured(df: DataFrame, models: list[Model], text_col: str = "text", model_col: str = "model") -> DataFrame:
    """``df`` with ``distances`` array<double> in place of the text, by the model whose number ``model_col`` holds."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def make() -> Callable:
        pairs = [m.compressors() for m in shared.value]
        return lambda column: [pa.array([distances(b, *pairs[m]) for b, m in zip(utf8(column.field(0)), column.field(1).to_pylist(), strict=True)], pa.list_(pa.float64()))]

    both = df.withColumn("_both", F.struct(text_col, model_col)).drop(text_col)
    return add_columns(both, "_both", T.StructType([T.StructField("distances", T.ArrayType(T.DoubleType()))]), make, drop_source=True)


def untrained(ordinary: bytes, toxic: bytes) -> Model:
    return Model(ordinary, toxic, np.zeros(WIDTH + 1), np.zeros(WIDTH), np.ones(WIDTH))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels).withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int"))
    plain: list[bytes] = []
    toxic: list[list[bytes]] = [[] for _ in range(FOLDS)]
    size = 0
    for row in sample.orderBy("key", "text").toLocalIterator():
        body = (row.text or "").encode()
        size += len(body)
        if size > SAMPLE_BYTES:
            break
        if row.toxic:
            toxic[row.fold].append(body)
        elif row.fold % 2 == 0:
            plain.append(body)
    ordinary = dictionary(plain, ORDINARY)
    whole = sum(len(b) for part in toxic for b in part)
    trained = lambda parts: untrained(ordinary, dictionary([b for part in parts for b in part], TOXIC, whole))
    unseen = [trained(toxic[:k] + toxic[k + 1 :]) for k in range(FOLDS)]
    model = trained(toxic)
    del plain, toxic
    turn = F.when(F.col("toxic") == 1, F.col("fold")).otherwise(F.pmod(F.shiftright("key", 8), F.lit(FOLDS)).cast("int"))
    tried = sample.where("toxic = 1 or fold % 2 = 1").withColumn("model", turn)
    rows = measured(tried.select("text", "toxic", "model"), unseen).select("distances", "toxic").toArrow().to_pydict()
    y = np.array(rows["toxic"], float)
    if len(set(y.tolist())) < 2:
        model.weights[-1] = 30 * (1 if len(y) and y[0] else -1)
        return model
    model.weights, model.centre, model.spread = fit(np.array(rows["distances"]), y)
    model.weights[-1] += np.log(ODDS * (1 - y.mean()) / y.mean())
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted`` in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        pair = shared.value.compressors()

        def kernel(column: pa.Array) -> list:
            x = np.array([distances(b, *pair) for b in utf8(column)]).reshape(len(column), -1)
            s = shared.value.scores(x) if len(x) else np.empty(0)
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

        return kernel

    return add_columns(df, text_col, FIELDS, make, drop_source=True)


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = held_out(read_table(spark, sf_dir, "labels").select("doc_id", "toxic")).where(~F.col("held_out"))
    model = learn(docs, labels)
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
