"""Approximate nearest neighbours by learned partitions (operator 11).

``fit`` takes a bounded sample of vectors: it links each to its nearest ones, cuts this neighbour graph into parts of
equal size by recursive spectral bisection with a median split and swaps that lessen the cut, and trains a network of
one hidden layer to tell from a vector in which parts its neighbours lie. ``indexed`` gives every vector of the table
the part it most probably belongs to. ``routed`` gives a query its most probable parts, as many as reach the
probability at which RECALL of the neighbours of sample vectors that weren't learned from were found. ``reranked``
meets queries and vectors of a part in blocks of both, and compares by the exact cosine.

Sizes: the sample has at most SAMPLE vectors and is fitted in one task; the model is a few hundred kB and goes to the
tasks; a block has about BLOCK vectors and QUERIES queries, since parts are split by a hash into as many blocks as
their counts ask for. Equal vectors are one row of the index with their ``K`` + 1 smallest ids, which is all that an
answer can hold of them.

Defined results: null, zero and non-finite vectors, those with a null or non-finite component, and rows without an id
take no part; shorter vectors count as padded with zeros; of rows with one id the smallest vector counts; equal scores
go to the smaller id; a table with no more than one part is searched whole; an empty table gives no rows; other
columns don't matter."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, small_batches

K = 5
#: Vectors that the model is fitted on at most, and about how many of them make a part.
SAMPLE, PART = 8_192, 96
SEED = 42
#: Neighbours of a sample vector in the graph; rounds of the iterations; the network.
LINKS, SPECTRAL, SWAPS, HIDDEN, EPOCHS, BATCH, RATE = 24, 80, 12, 256, 12, 256, 2e-3
#: Share of the sample that calibrates, and the recall asked for there.
HELD, RECALL = 0.2, 0.95
BLOCK, QUERIES = 4_096, 1_024


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    twice = materialise(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "ann-repeated")
    least = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(least)


def distinct(rows: DataFrame) -> DataFrame:
    """(ids, v): each vector once, with its K + 1 smallest ids."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= K + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, padded with zeros and scaled by powers of two, which changes no cosine."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(ends.max(initial=0))))
    at = np.arange(out.shape[1]) < ends[:, None]
    out[at] = column.flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Rows of y nearest to each of x, nearest first; ``skip`` names one to leave out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ y.T
        if skip is not None:
            s[np.arange(len(s)), skip[at : at + 512]] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def bisected(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves (0 and 1) of the graph with links a[i] - b[i] over n nodes: the order of the second eigenvector of the
    random walk, cut in the middle, then swaps of pairs while they lessen the cut."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    spread = lambda x: np.bincount(a, x[b], n) + np.bincount(b, x[a], n)
    x = rng.standard_normal(n)
    for _ in range(SPECTRAL):
        x -= (x * degree).sum() / degree.sum()
        x = (x + spread(x) / degree) / 2
        x /= np.sqrt((x * x).sum()) + 1e-300
    side = np.zeros(n, np.int64)
    side[np.argsort(x, kind="stable")[n // 2 :]] = 1
    cut = (side[a] != side[b]).sum()
    for _ in range(SWAPS):
        gain = degree - 2 * np.where(side == 0, spread((side == 0) * 1.0), spread((side == 1) * 1.0))
        left, right = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
        pairs = min(len(left), len(right))
        good = int((gain[left[:pairs]] + gain[right[:pairs]] > 1e-6).sum())
        if not (take := (good + 1) // 2):
            break
        tried = side.copy()
        tried[left[:take]], tried[right[:take]] = 1, 0
        if (now := (tried[a] != tried[b]).sum()) >= cut:
            break
        side, cut = tried, now
    return side


def partitioned(links: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """2 ** levels balanced parts of the graph in which row i links to ``links[i]``."""
    n = len(links)
    a, b = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        after = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            after[own] += bisected(place[a[inside]], place[b[inside]], len(own), rng)
        part = after
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Of each part, for unit vectors x."""
    d = len(model["weights"][0])
    x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
    w1, b1, w2, b2 = model["weights"]
    return softmax(np.maximum(x @ w1 + b1, 0) @ w2 + b2)


def trained(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights of the network, by Adam on the cross entropy with the shares ``target``."""
    sizes = (x.shape[1], HIDDEN, target.shape[1])
    w = [rng.standard_normal((sizes[0], sizes[1])) * np.sqrt(2 / sizes[0]), np.zeros(sizes[1]), rng.standard_normal((sizes[1], sizes[2])) * np.sqrt(1 / sizes[1]), np.zeros(sizes[2])]
    m, v, t = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            off = (softmax(h @ w[2] + w[3]) - target[at]) / len(at)
            back = (off @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def fitted(x: np.ndarray) -> dict:
    """The model of a sample of unit vectors: weights, parts, and the probability that a query's parts shall reach."""
    rng = np.random.default_rng(SEED)
    levels = max(0, int(np.log2(max(1, len(x)) / PART)))
    if not levels:
        return {"parts": 1}
    links = nearest(x, x, LINKS, np.arange(len(x)))
    part = partitioned(links, levels, rng)
    target = np.zeros((len(x), 1 << levels))
    np.add.at(target, (np.repeat(np.arange(len(x)), LINKS), part[links].ravel()), 1.0)
    target[np.arange(len(x)), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    held = rng.random(len(x)) < HELD
    model = {"parts": 1 << levels, "weights": trained(x[~held], target[~held], rng)}
    p = probabilities(model, x)
    home = p.argmax(axis=1)
    # The probability passed before the part of a neighbour is reached; the quantile of it is what queries go up to
    order = np.argsort(-p[held], axis=1, kind="stable")
    ranked = np.take_along_axis(p[held], order, 1)
    need = np.take_along_axis(np.cumsum(ranked, axis=1) - ranked, np.take_along_axis(np.argsort(order, axis=1), home[links[held][:, :K]], 1), 1)
    model["reach"] = float(np.quantile(need, RECALL)) if held.any() else 1.0
    return model


def fit(index: DataFrame) -> dict:
    """The model of the distinct vectors (ids, v), from SAMPLE of them by a hash of their smallest id."""
    n = index.count()
    mark = F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit(SEED)), F.lit(1 << 32))
    bar = (1 << 32) if n <= SAMPLE else int((1 << 32) * 1.3 * SAMPLE / n) + 1
    few = index.select(mark.alias("mark"), F.element_at("ids", 1).alias("id"), "v").where(F.col("mark") < bar).orderBy("mark", "id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        x = matrix(pa.Table.from_batches(rows).column("v")) if rows else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(unit(x)))], pa.binary())], names=["model"])

    return pickle.loads(few.coalesce(1).mapInArrow(run, "model binary").first().model)


def indexed(index: DataFrame, model: dict) -> DataFrame:
    """(ids, v, part): every vector with its most probable part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            if model["parts"] > 1 and batch.num_rows:
                part = probabilities(model, unit(matrix(batch.column("v")))).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["ids", "v", "part"])

    return index.select("ids", "v").mapInArrow(run, "ids array<long>, v array<double>, part int")


def routed(queries: DataFrame, model: dict, sizes: dict[int, int]) -> DataFrame:
    """(query_id, v, parts): the most probable parts of each query that hold vectors. ``sizes``: vectors by part."""
    there = np.array([sizes.get(k, 0) for k in range(model["parts"])])

    def chosen(p: np.ndarray) -> np.ndarray:
        order = np.argsort(-p, kind="stable")
        order = order[there[order] > 0]
        before = np.cumsum(p[order]) - p[order]
        found = np.cumsum(there[order]) - there[order]
        return order[(before <= model["reach"]) | (found - there[order] < K + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(1, np.int64)] * batch.num_rows
            if model["parts"] > 1 and batch.num_rows:
                parts = [chosen(p) for p in probabilities(model, unit(matrix(batch.column("v"))))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["query_id", "v", "parts"])

    return queries.select("query_id", "v").mapInArrow(run, "query_id long, v array<double>, parts array<int>")


def block_best(query_ids: list[int], q: np.ndarray, ids: list[list[int]], c: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """(query, id, cosine) of the K best of a block for each query, itself left out: a product finds who can be among
    them, and their cosines are taken one by one, so that they don't depend on the block."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    nq, nc = (np.sqrt((x * x).sum(axis=1)) for x in (q, c))
    s = (q / nq[:, None]) @ (c / nc[:, None]).T
    k = min(K + 1, s.shape[1])
    bar = -np.partition(-s, k - 1, axis=1)[:, k - 1] - 1e-9
    at, of = np.nonzero(s >= bar[:, None])
    exact = (q[at] * c[of]).sum(axis=1) / (nq[at] * nc[of])
    best: dict[int, list[tuple[float, int]]] = {}
    for i, j, x in zip(at.tolist(), of.tolist(), exact.tolist(), strict=True):
        best.setdefault(i, []).extend((-x, own) for own in ids[j] if own != query_ids[i])
    rows = [(query_ids[i], own, -x) for i, found in best.items() for x, own in sorted(found)[:K]]
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])


def reranked(queries: DataFrame, index: DataFrame, vectors: dict[int, int], asked: dict[int, int]) -> DataFrame:
    """(query_id, rank, vec_id, score): the K best of the parts of each query. ``vectors`` and ``asked``: rows by part."""
    spark = index.sparkSession
    blocks = [(p, max(1, -(-n // BLOCK)), max(1, -(-asked.get(p, 0) // QUERIES))) for p, n in vectors.items()]
    split = F.broadcast(spark.createDataFrame(blocks, "part int, cs int, qs int"))
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(SEED)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = index.join(split, "part").withColumn("c", spread(F.element_at("ids", 1), F.col("cs"))).withColumn("q", each(F.col("qs"))).select("part", "c", "q", "ids", "v")
    sent = queries.join(split, "part").withColumn("q", spread("query_id", F.col("qs"))).withColumn("c", each(F.col("cs"))).select("part", "c", "q", "query_id", "v")
    kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = ([], [], [])
        if left.num_rows and right.num_rows:
            made = block_best(left.column("query_id").to_pylist(), matrix(left.column("v")), right.column("ids").to_pylist(), matrix(right.column("v")))
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(kinds, made, strict=True)})

    keys = ("part", "c", "q")
    found = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query) -> DataFrame:
    """The nearest vectors of the rows (vec_id, embedding) for which ``is_query`` holds, among all others."""
    small_batches(vectors.sparkSession)
    rows = materialise(valid(vectors), "ann-vectors")
    whole = materialise(distinct(rows), "ann-distinct")
    model = fit(whole)
    index = materialise(indexed(whole, model), "ann-index")
    sizes = lambda df: {r.part: r.n for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
    vectors_by = sizes(index)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialise(routed(queries, model, vectors_by).select("query_id", "v", F.explode("parts").alias("part")), "ann-queries")
    return reranked(asked, index, vectors_by, sizes(asked))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
