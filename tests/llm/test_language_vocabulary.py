import math

from meshframe.llm import language


def test_ties_fill_the_vocabulary_and_counts_are_of_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "VOCABULARY", 5)
    alike = " ".join(f"same{chr(97 + i)}" for i in range(20))
    rows = [(alike, "aa"), ("two two two three three samea", "bb"), ("top top top mid mid mid mid low", "cc"), ("lone low low low", "dd")]
    counts = language.word_counts(spark.createDataFrame(rows, "text string, lang string"))
    got = language.frequent(counts).collect()
    per = {x: sorted(r.word for r in got if r.lang == x) for x in ("aa", "bb", "cc", "dd")}
    assert len(per["aa"]) == len(set(per["aa"])) == 5 and set(per["aa"]) < set(alike.split())
    assert per["bb"] == ["samea", "three", "two"] and per["cc"] == ["low", "mid", "top"] and per["dd"] == ["lone", "low"]
    again = {r.word for r in language.frequent(counts.repartition(7)).collect() if r.lang == "aa"}
    assert again == set(per["aa"])


def test_a_word_below_the_bar_keeps_its_count(spark, monkeypatch):
    monkeypatch.setattr(language, "VOCABULARY", 2)
    rows = [("top top top mid mid mid seen", "aa"), ("seen seen", "bb")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.words.keys) == 3 and sorted(model.places(["mid", "seen", "top", "other"]))[:2] == [-1, 0]
    import numpy as np

    logs = model.words.logs(model.places(["seen"]), np.zeros(1, int), 1)[0]
    assert abs(logs[0] - math.log((1 + language.SMOOTH) / (7 + 3 * language.SMOOTH))) < 1e-5


def test_every_language_can_be_predicted(spark):
    rows = [(f"word{chr(97 + i // 26)}{chr(97 + i % 26)} common", f"l{i:03d}") for i in range(90)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 90
    got = language.predict(spark.createDataFrame(rows, "text string, lang string"), model, evidence=True).collect()
    assert all(r.lang_pred == r.lang and r.evidence == 1 for r in got)


def test_text_of_no_learnt_script_has_no_evidence(spark):
    model = language.learn(spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr")], "text string, lang string"))
    got = language.predict(spark.createDataFrame([("漢字仮名 文章 言語",), ("the tapis",)], "text string"), model, evidence=True).collect()
    assert got[0].evidence < 0.5 and got[1].evidence == 1
