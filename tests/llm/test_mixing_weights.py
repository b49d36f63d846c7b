import math
from itertools import islice

import pytest

from meshframe.llm import mixing


def worst(counts, weights):
    """The largest deviation from the exact weights at any slot of the first phase."""
    share, served = sum(weights.values()), dict.fromkeys(counts, 0)
    most = 0.0
    for phase, s, block, slot, lag in mixing.places(counts, mixing.allotments(weights)):
        if phase:
            break
        assert block == served[s]
        served[s] += 1
        assert lag == pytest.approx(weights[s] / share * (slot + 1) - served[s], abs=1e-6)
        if slot % 97 == 0:
            most = max(most, *(abs(w / share * (slot + 1) - served[x]) for x, w in weights.items()))
    return most


def test_deviation_does_not_grow_with_the_phase():
    counts = {"hot": 20_000, **{f"s{i}": 3_000 for i in range(15)}}
    assert worst(counts, {s: math.sqrt(n) for s, n in counts.items()}) < 1


def test_many_small_sources_keep_their_weight():
    weights = {"big": 0.9, **{f"s{i}": 0.1 / 900 for i in range(900)}}
    assert worst(dict.fromkeys(weights, 20_000), weights) < 1
    first = list(islice(mixing.earliest(mixing.allotments(weights)), 1_800))
    assert abs(first.count("big") - 1_620) < 1


def test_pieces_and_weight_zero(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(99)], "doc_id long, source string")
    whole = {(r.doc_id, r.block, r.slot, r.phase, r.lag) for r in mixing.schedule(docs, {"a": 2, "b": 1, "c": 0}, 2).collect()}
    monkeypatch.setattr(mixing, "PIECE", 5)
    assert {(r.doc_id, r.block, r.slot, r.phase, r.lag) for r in mixing.schedule(docs, {"a": 2, "b": 1, "c": 0}, 2).collect()} == whole
    assert {x[0] % 3 for x in whole if x[2] >= 34} == {2} and len(whole) == 99
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"a": 2, "b": 1, "c": -1})
