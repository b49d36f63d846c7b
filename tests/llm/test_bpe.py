import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import bpe
from tests.conftest import SF

RANKS = P.path("byte_bpe_50k.tiktoken")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = {p: library(p) for p in (RANKS, MULTI)}
SPELL = {p: bpe.Speller(bpe.read_ranks(p), P.PATTERN) for p in (RANKS, MULTI)}
HARD = ["", " ", "  a", "a \n b", "a\n\n b  \t c ", "don't we'll x'S", "\x1c\x1da b", "１２ ½³ a  b　c", "a" * 5000, "ab" * 3000, "😀 🏳️‍🌈!!", "퟿ a  b", "<|endoftext|> x", "   ", "a   ", "\r\n x", "-" * 3001, " \u0085 y", "x ​ y"]


def ids(spell, texts):
    import numpy as np

    return [np.frombuffer(b, "<i4").tolist() for b in spell(texts)]


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_hard_texts_as_the_library(path):
    assert ids(SPELL[path], HARD) == [LIBRARY[path].encode_ordinary(t) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdefghij 'stn\n\t12.,!éß€漢😀  \x1c"), max_size=60), max_size=6))
def test_any_texts_as_the_library(texts):
    for path in (RANKS, MULTI):
        assert ids(SPELL[path], texts) == [LIBRARY[path].encode_ordinary(t) for t in texts]


def test_replay_agrees_with_single_words():
    replay = bpe.MergeReplay(bpe.read_ranks(RANKS))
    words = [b"", b"a", b"lowest", b"newest", "žluťoučký".encode(), b"aaaaaaaaaaa", bytes(range(256)), b"abcabcabcabd" * 40]
    assert [list(memoryview(b).cast("i")) for b in replay.encode(words)] == [replay.encode_one(w) for w in words]
    assert [bpe.read_ranks(RANKS)[i] for i in replay.encode_one(words[3])] and replay.encode([]) == []


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 2_000)
    monkeypatch.setattr(bpe, "SLICE", 50)
    spell = bpe.Speller(bpe.read_ranks(RANKS), P.PATTERN)
    texts = [f"word{i} other{i % 3} {'x' * i}" for i in range(60)]
    assert ids(spell, texts + texts) == [LIBRARY[RANKS].encode_ordinary(t) for t in texts + texts]
    assert spell.held <= bpe.HELD


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"\p{L}+|\s+|[^\p{L}\s]+", r"(\p{L})+|(\s)|.", r"[a-z]+"])
def test_other_patterns_as_the_library(pattern):
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=LIBRARY[RANKS]._mergeable_ranks, special_tokens={})
    texts = ["hello there friend, abc. done", "a  b c", *HARD]
    assert ids(bpe.Speller(bpe.read_ranks(RANKS), pattern), texts) == [theirs.encode_ordinary(t) for t in texts]


def test_query_as_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op1_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = LIBRARY[RANKS].encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_round_trip_and_digests(spark):
    rows = [(1, "a b  c", "x"), (2, None, "y"), (3, "", None), (None, "a b  c", "z"), (1, "a b  c", "x"), (4, "naïve 漢字 " * 4000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((r.decoded for r in got)) == sorted(((t or "").encode() for _, t, _ in rows))
    for r in bpe.digest(docs, RANKS, P.PATTERN).collect():
        want = LIBRARY[RANKS].encode_ordinary(next((t or "" for i, t, _ in rows if i == r.doc_id)))
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(docs, RANKS, P.PATTERN).count() == 0
