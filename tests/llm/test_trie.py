import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from meshframe.llm import trie
from tests.conftest import SF

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow(rows):
    """The nodes by going through every prefix; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts or before))
    try:
        return got(trie.nodes(trie.rebuilt(trie.sequences(df))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert got(trie.op12_trie(spark, SF)) == slow(rows)


def test_many_shared_prefixes_over_many_blocks(spark):
    rng = random.Random(3)
    rows = []
    for c in range(400):
        for t in range(rng.choice([1, 2, 3, 3, 3, 12])):
            rows.append((c, t, "user", rng.choice(["a", "a", "é", "long " * 5])))
    for parts in (1, 3, 23):
        assert made(spark, rows, parts) == slow(rows), parts


def test_copies_chains_and_prefixes(spark):
    same = [(c, t, "u", f"t{t}") for c in range(0, 300, 5) for t in range(40)]
    longer = [(1000 + 5 * c, t, "u", f"t{t}") for c in range(30) for t in range(c + 1)]
    assert made(spark, same + longer, 7) == slow(same + longer)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "x"), (1, None, None, None), (1, 0, "u", ""), (6, None, None, None), (6, 0, "u", "x" * 200_000), (2, 0, "", "a"), (3, 0, "", "a"), (7, 1, "u", "a"), (10, 1, "u:", "a"), (15, 1, "u", ":a")]
    assert made(spark, rows, 3) == slow(rows)
    assert made(spark, rows[3:5], 3) == slow(rows[3:5])
    assert made(spark, [(3, 0, "u", "a")]) == slow([(3, 0, "u", "a")])
    assert made(spark, rows[:1]) == []


def test_other_columns_and_repeats(spark):
    rows = [(c, 0, "u", "same") for c in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "depth": F.lit("x"), "low": F.lit(2)})
    assert got(trie.nodes(trie.rebuilt(trie.sequences(df)))) == slow(rows)
    assert made(spark, rows + rows) == slow(rows + rows)


def test_nearest_smaller():
    rng = random.Random(1)
    values = [rng.randrange(6) for _ in range(200)]
    assert trie.nearest_smaller(values) == [max((j for j in range(k) if values[j] < v), default=-1) for k, v in enumerate(values)]
