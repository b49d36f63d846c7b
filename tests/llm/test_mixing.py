import math
from collections import Counter
from fractions import Fraction
from itertools import islice

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshframe.llm import mixing

SHARES = st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1)


def slow(blocks, share):
    """(phase, source, block, slot): in each slot all released blocks are looked at and the one due first is served; a
    phase ends with the source that runs out."""
    served, out, phase = dict.fromkeys(blocks, 0), [], 0
    while left := [s for s in blocks if served[s] < blocks[s]]:
        rates = {s: share[s] for s in left if share[s]} or dict.fromkeys(left, 1)
        whole, first, slot = sum(rates.values()), dict(served), 0
        while all(served[s] < blocks[s] for s in rates):
            due = []
            for s, rate in rates.items():
                j = served[s] - first[s] + 1
                if Fraction(j - 1) * whole / rate < slot + 1:  # released at its floor
                    due.append((math.ceil(Fraction(j) * whole / rate), s))
            when, s = min(due)
            assert when > slot
            out.append((phase, s, served[s], len(out)))
            served[s] += 1
            slot += 1
        phase += 1
    return out


@settings(max_examples=150, deadline=None)
@given(SHARES)
def test_every_slot_deviates_by_less_than_a_block(share):
    length, served = sum(share.values()), Counter()
    for t, s in enumerate(islice(mixing.earliest(share), length)):
        served[s] += 1
        assert all(abs(c * (t + 1) / length - served[x]) < 1 for x, c in share.items())
    assert served == Counter(share)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1), st.lists(st.integers(0, 9), min_size=6, max_size=6))
def test_places_are_those_of_looking_at_all_blocks(blocks, weights):
    share = mixing.allotments({s: weights["abcdef".index(s)] for s in blocks})
    assert [x[:4] for x in mixing.places(blocks, share)] == slow(blocks, share)


def test_query_against_brute_force(spark):
    from tests.conftest import SF

    rows = mixing.op6_mixing(spark, SF).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in rows} == docs and len(rows) == len(docs)
    assert all(abs(r.lag) < 1 for r in rows)
    held = Counter((r.source, r.block) for r in rows)
    sizes = Counter(docs.values())
    assert all(held[s, b] == (mixing.BLOCK if (b + 1) * mixing.BLOCK <= n else n % mixing.BLOCK) for s, n in sizes.items() for b in range(-(-n // mixing.BLOCK)))
    want = slow({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, {s: Fraction(n**0.5) for s, n in sizes.items()})
    assert {(r.phase, r.source, r.block, r.slot) for r in rows} == set(want)


def test_mix_keeps_rows_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rows = [(i, "x", ("a", "b", None, "")[i % 4] if i % 3 else "a", 5) for i in range(90)] + [(1, "x", "b", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    mixed = mixing.mix(docs, {"a": 1, "b": 1, "": 2}, 2)
    assert Counter(map(tuple, mixed.collect())) == Counter(rows) and mixed.columns == docs.columns
    order = [r.source or "" for r in mixed.collect()]
    assert Counter(order[:24]) == {"": 12, "a": 6, "b": 6}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1})
    assert mixing.mix(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(SHARES, st.integers(0, 300), st.integers(0, 40))
def test_a_guess_keeps_the_number_of_blocks_and_a_true_start_goes_on(share, slot, warm):
    served = mixing.advanced(share, 0, dict.fromkeys(share, 0), slot)
    assert [x for x in islice(mixing.earliest(share, slot, served), 50)] == list(islice(mixing.earliest(share), slot + 50))[slot:]
    assert sum(mixing.guess(share, slot, warm).values()) == slot


@pytest.mark.parametrize("warm", [0, 30])
def test_ranges_of_long_phases_make_the_schedule_of_looking_at_all_blocks(spark, monkeypatch, warm):
    """Phases in ranges of 7 slots; without a warm-up guesses go wrong and are mended, each range from the one before."""
    monkeypatch.setattr(mixing, "PIECE", 7)
    monkeypatch.setattr(mixing, "WARM", warm)
    blocks = {"a": 61, "b": 40, "c": 9, "d": 30, "e": 3, "": 14}
    share = mixing.allotments({"a": 0.37, "b": 2**0.5 / 7, "c": 0.011, "d": 0.2, "e": 0.0, "": 0.09})
    got = mixing.placed(spark, blocks, share).orderBy("slot").collect()
    assert [tuple(r) for r in got] == list(mixing.places(blocks, share))
    assert [tuple(r)[:4] for r in got] == slow(blocks, share)
