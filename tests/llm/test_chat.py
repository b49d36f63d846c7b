import hashlib
import json

import pytest

from meshframe.llm import chat

HARD = ["", "\\", "\\\\h", "###", "#####", "</turn>", "a</turn", "\\b\\h\\t", "x: y\n### user: z</turn>\n", "é漢😀", "</turn></turn>\n", "\\c:", "</tu###rn>"]


def test_escapes_are_reversible(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e


def test_rows_read_back(spark):
    rows = [(1, i, ("user", "assistant", None, "a: ###b")[i % 4], t) for i, t in enumerate([*HARD, None])]
    rows += [(2, 1, "assistant", "late"), (2, 0, "user", "first"), (2, 0, "user", "first"), (None, 0, "assistant", "n")]
    got = {r.conv_id: r for r in chat.summary(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"}, {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"}, {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    for r in chat.canonical(df, "record").collect():
        assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")], r
    odd = spark.createDataFrame([('{"x": 1}',), ("not json",), (None,), ("[1]",)], "record string")
    assert [r.turns for r in chat.canonical(odd, "record").collect()] == [None] * 4
    assert [r.formatted for r in chat.render(chat.canonical(odd, "record")).collect()] == [""] * 4


def test_clashing_columns_are_replaced(spark):
    rows = [(7, "x", "old", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turns string, keep string, segments int, formatted int").selectExpr("*", "struct('q' as prompt, 'a' as response) as record")
    made = chat.render(chat.canonical(df, "record"))
    r = made.first()
    assert made.columns == ["conv_id", "turns", "keep", "segments", "formatted", "record"] and (r.conv_id, r.keep) == (7, "old")
    assert [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")] and r.formatted == "### user: q</turn>\n### assistant: a</turn>\n"
    assert "".join(s.text for s in r.segments) == r.formatted and [s.text for s in r.segments if s.loss] == ["a"]
    assert chat.render(chat.canonical(df.limit(0), "record")).count() == 0
    told = spark.createDataFrame([(1, 0, "user", "hi", "x", "y", "z")], "conv_id long, turn long, role string, text string, turns string, segments string, formatted string")
    assert chat.summary(told).first().n_turns == 1


def test_struct_columns(spark):
    df = spark.createDataFrame([(("sys", "q", "a"),)], "record struct<system:string,prompt:string,response:string>")
    assert [t.role for t in chat.canonical(df, "record").first().turns] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([((1,),)], "record struct<x:int>"), "record")
    assert chat.summary(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
