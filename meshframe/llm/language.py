"""Language identification by word-first backoff (operator 7).

A text's words are scored by their log frequency in each language. A word that the model doesn't hold falls back to
character n-grams, from ORDERS[0] down: the longest order of which the word has a known n-gram decides, by the mean log
frequency of its known n-grams. Words and n-grams are known by 64-bit hashes of their own, so an unseen n-gram is not
taken for a seen one, however large the corpus.

Counts cover all learning rows. What the model keeps of them is bounded by language: the VOCABULARY most frequent words and
the GRAMS most frequent n-grams of each order are known; a known word or n-gram has its count in every language that has
it among the KEPT times as many most frequent known ones, and none elsewhere. These counts are kept sparsely, so the
model has at most about three MB a language, of as many languages as the learning rows name.

Defined results: null text and text without letters are ``und`` with score 0; rows without a language are
never learnt from; without any learning row every text is ``und``; ties go to the first language by name;
a text of any length is scored whole; repeated rows repeat their result; an empty table gives an empty table;
clashing columns are replaced."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, read_table, slices, texts, trim

VOCABULARY, GRAMS, KEPT = 50_000, 20_000, 2
ORDERS = (5, 4, 3, 2, 1)
#: Counted n-grams that a task holds before it hands them on.
HELD = 1 << 20
#: Words of one count are told apart by so many leading bits of their hash before they are ranked.
PART_BITS = 12
#: Words a task counts, or remembers the scores of, before it hands them on or forgets them; characters it scores at once.
MEMORY, BLOCK = 200_000, 500_000
#: The shortest n-grams that are evidence of a language.
EVIDENCE = 2
SMOOTH = 0.5
#: The seed of Spark's xxhash64 (fixed value).
HASH_SEED = 42
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def words_of(text: str) -> list[str]:
    """The lower-case words of a text; none if it has no letter."""
    words = WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def gram_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-grams of words between marks, and how many each word has."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    if len(code) < order:
        return np.empty(0, np.uint64), np.zeros(len(words), np.int64)
    ends = np.cumsum(sizes)
    h = np.zeros(len(code) - order + 1, np.uint64)
    for i in range(order):
        h = (h + code[i : len(code) - order + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    inside = np.ones(len(code), bool)
    for i in range(1, order):
        inside[np.maximum(ends - i, ends - sizes)] = False
    return h[inside[: len(h)]], np.maximum(sizes - order + 1, 0)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows with a language, combined in tasks before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                lang, c = held.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in (part for b in batches for part in slices(b)):
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > MEMORY:
                    yield from flush()
        yield from flush()
        trim()

    rows = docs.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, grams, word, n) from counted words, ``word`` the n-gram's hash; summed in each task in runs of HELD."""
    kinds = {"lang": pa.string(), "grams": pa.int32(), "word": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, order), parts in held.items():
                keys, row = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(row, np.concatenate([m for _, m in parts])).astype(np.int64)
                columns = ([lang] * len(keys), [order] * len(keys), keys.view(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
            held.clear()

        for batch in batches:
            lang, word, n = (batch.column(c).to_pylist() for c in range(3))
            by: dict[str, list[int]] = {}
            for i, x in enumerate(lang):
                by.setdefault(x, []).append(i)
            for x, rows in by.items():
                weight, mine = np.array([n[i] for i in rows], float), [word[i] for i in rows]
                for order in ORDERS:
                    keys, many = gram_keys(mine, order)
                    held.setdefault((x, order), []).append((keys, np.repeat(weight, many)))
                    size += len(keys)
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()
        trim()

    made = counts.select("lang", "word", "n").mapInArrow(run, "lang string, grams int, word long, n long")
    return made.groupBy("lang", "grams", "word").agg(F.sum("n").alias("n"))


def rising(counts: DataFrame, order: list, by: str) -> DataFrame:
    """(lang, ``by``, before, words): how many words have each value, and how many those before it in ``order``."""
    prior = Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.groupBy("lang", by).agg(F.count("*").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(prior), F.lit(0)))


def frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """(lang, word, n): the ``most`` (VOCABULARY) most frequent words of each language, those of one count in the order of a
    hash. The bar comes from how many words have each count; among the words at the bar, it comes from how many
    have each leading part of the hash, so that no language's words meet in a task but those of one part."""
    most = VOCABULARY if most is None else most
    ranked = rising(counts, [F.desc("n")], "n")
    bar = ranked.where((F.col("before") < most) & (F.col("before") + F.col("words") > most)).select("lang", F.col("n").alias("bar"), (most - F.col("before")).alias("room"))
    least = ranked.where(F.col("before") < most).groupBy("lang").agg(F.min("n").alias("least"))
    marked = counts.join(F.broadcast(least), "lang").where("n >= least").join(F.broadcast(bar), "lang", "left")
    hashed = F.xxhash64("word")
    split = marked.withColumns({"_tied": F.coalesce(F.col("n") == F.col("bar"), F.lit(False)), "_part": F.shiftrightunsigned(hashed, 64 - PART_BITS)})
    tied = split.where("_tied")
    edge = rising(tied, [F.col("_part")], "_part").join(F.broadcast(bar), "lang").where("before < room").select("lang", "_part", (F.col("room") - F.col("before")).alias("_left"))
    place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(hashed, "word"))
    filled = tied.join(F.broadcast(edge), ["lang", "_part"]).withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    return split.where("not _tied").select("lang", "word", "n").unionByName(filled.select("lang", "word", "n"))


def known(counts: DataFrame, most: int) -> DataFrame:
    """(lang, grams, word, n): the words among the ``most`` of any language and order ``grams``, with their counts in the
    languages that have them among KEPT times as many of these. Languages and orders go together as one name."""
    named = counts.select(F.concat(F.col("grams").cast("string"), F.lit(":"), F.col("lang")).alias("lang"), "word", "n")
    order = F.substring_index("lang", ":", 1).cast("int").alias("grams")
    chosen = materialise(frequent(named, most).select(order, "word").distinct(), "known")
    kept = frequent(named.select("*", order).join(chosen, ["grams", "word"], "left_semi"), KEPT * most)
    return kept.select(F.expr("substring(lang, instr(lang, ':') + 1)").alias("lang"), order, "word", "n")


class Table:
    """Log frequencies by key and language, where they differ from that of a key the language lacks."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, sizes: np.ndarray):
        """Entries (key, lang, n), and all occurrences by language."""
        self.keys, row = np.unique(key, return_inverse=True)
        order = np.lexsort((lang, row))
        self.start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.keys)))])
        self.lang = lang[order].astype(np.uint16 if len(sizes) < 1 << 16 else np.int64)
        whole = sizes + SMOOTH * max(1, len(self.keys))
        self.none = np.log(SMOOTH / whole).astype(np.float32)
        self.more = (np.log((n[order] + SMOOTH) / whole[self.lang]) - self.none[self.lang]).astype(np.float32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def logs(self, rows: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """(owner, language): the sums over the rows of each owner."""
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        wide = len(self.none)
        out = np.bincount(np.repeat(owner, sizes) * wide + self.lang[at], self.more[at], owners * wide).reshape(owners, wide)
        return out + np.bincount(owner, minlength=owners)[:, None] * self.none

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.start, self.lang, self.none, self.more))


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def places(self, words: list[str]) -> np.ndarray:
        """The row of each word in the table of words, or -1."""
        import xxhash

        return self.words.find(np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), HASH_SEED) for w in words], np.uint64))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows of ``docs`` with a language. What reaches the driver is bounded by KEPT times VOCABULARY words
    and KEPT times GRAMS n-grams of each order for each language."""
    counts = materialise(word_counts(docs, text_col, lang_col), "words")
    grams = materialise(gram_counts(counts), "grams")
    total = F.sum("n").alias("n")
    sizes = {(r.lang, r.grams): float(r.n) for r in counts.groupBy("lang", F.lit(0).alias("grams")).agg(total).unionByName(grams.groupBy("lang", "grams").agg(total)).collect()}
    langs = sorted({x for x, _ in sizes})

    at = {x: i for i, x in enumerate(langs)}

    def entries(df: DataFrame, key: Column) -> list[np.ndarray]:
        got = df.select("lang", "grams", key.alias("key"), "n").toArrow()
        return [np.array([at[x] for x in got.column("lang").to_pylist()], np.int64), *(got.column(c).to_numpy() for c in ("grams", "key", "n"))]

    def table(order: int, lang: np.ndarray, grams: np.ndarray, key: np.ndarray, n: np.ndarray) -> Table:
        own = grams == order
        return Table(key[own].view(np.uint64), lang[own], n[own], np.array([sizes.get((x, order), 0.0) for x in langs]))

    words = table(0, *entries(known(counts.withColumn("grams", F.lit(0)), VOCABULARY), F.xxhash64("word")))
    held = entries(known(grams, GRAMS), F.col("word"))
    return Model(langs, words, {o: table(o, *held) for o in ORDERS})


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """(word, language) log scores: the vocabulary first, then the longest order with a known n-gram. One more column
    tells whether there was evidence of EVIDENCE characters or more."""
    out = np.zeros((len(words), len(model.languages) + 1), np.float32)
    rows = model.places(words)
    held = np.flatnonzero(rows >= 0)
    out[held, :-1] = model.words.logs(rows[held], np.arange(len(held)), len(held))
    out[held, -1] = 1
    left = np.flatnonzero(rows < 0)
    for order in ORDERS:
        if not len(left):
            break
        keys, many = gram_keys([words[i] for i in left], order)
        at = model.grams[order].find(keys)
        owner = np.repeat(np.arange(len(left)), many)[at >= 0]
        found = np.bincount(owner, minlength=len(left))
        mean = model.grams[order].logs(at[at >= 0], owner, len(left)) / np.maximum(found, 1)[:, None]
        out[left[found > 0], :-1] = mean[found > 0]
        out[left[found > 0], -1] = order >= EVIDENCE
        left = left[found == 0]
    return out


class Scorer:
    """Predicts batches of texts; remembers the scores of the words met, up to MEMORY and those of a block."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages) + 1), np.float32)

    def __call__(self, batch: list[str]) -> list[tuple[str, float, float]]:
        out: list[tuple[str, float, float]] = []
        at = size = 0
        for end, text in enumerate(batch, 1):
            size += len(text)
            if size >= BLOCK or end == len(batch):
                out.extend(self.block(batch[at:end]))
                at, size = end, 0
        return out

    def block(self, batch: list[str]) -> list[tuple[str, float, float]]:
        cut = [words_of(t) for t in batch]
        if len(self.row) > MEMORY:
            self.forget()
        new = list({w for ws in cut for w in ws} - self.row.keys())
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, word_scores(self.model, new)])
        return [self.one(ws) for ws in cut]

    def one(self, words: list[str]) -> tuple[str, float, float]:
        """(language, score, share of the words with evidence)"""
        if not words or not self.model.languages:
            return UNKNOWN, 0.0, 0.0
        total = self.logs[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=float)
        best = int(total[:-1].argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum(total[:-1] - total[best], 0)).sum()), float(total[-1] / len(words))


def predict(df: DataFrame, model: Model, text_col: str = "text", drop_text: bool = False, evidence: bool = False) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior share of the predicted language; with ``evidence``
    also the share of the text's words that the model knows or that hold an n-gram it knows."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([*FIELDS.fields, *([T.StructField("evidence", T.DoubleType())] if evidence else [])])

    def make() -> Callable:
        scorer = Scorer(shared.value)

        def kernel(column: pa.Array) -> list:
            made = scorer(texts(column))
            return [pa.array([r[k] for r in made], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64())[: len(fields)])]

        return kernel

    return add_columns(df, text_col, fields, make, drop_source=drop_text)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model, drop_text=True).select("doc_id", "held_out", "lang_pred", "score")
