import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import records as P
from lodestat.operators.preprocess import AnalysisError


def test_verified_answers(spark):
    rows = [
        (["long good ", "tie a", "tie b", "x"], [True, True, True, None], [True, True, True, True], ["stop", "eos"], None),
        (["short"], [True], [True], ["length"], "sol"),
        (["wrong", "right one"], [False, True], [True, True], [], " sol "),
        (["a"], [True], [], [], None),
        (None, None, None, None, "sol"),
        ([], [], [], [], None),
    ]
    df = spark.createDataFrame(rows, "g array<string>, c array<boolean>, d array<boolean>, f array<string>, s string")
    got = [r[0] for r in df.select(P.verified_answer(*map(F.col, "gcdfs"))).collect()]
    assert got == ["tie a", None, "sol", None, None, None]


def test_joins_by_hash_and_parents(spark):
    r = spark.createDataFrame([(1, "h1"), (2, "h2"), (2, "h2")], "id int, h string")
    s = spark.createDataFrame([(1, "h1", "m", 0.5), (2, "old", "m", 0.6), (2, "h2", "other", 0.7), (3, "h3", "m", 0.8)], "id int, h string, model string, v double")
    assert [x["v"] for x in P.pinned(s, r, ["id"], {"model": "m"}, "h").collect()] == [0.5]
    assert P.matched([r.distinct(), s.select("id", "h")], ["id"], "h").count() == 2
    p = spark.createDataFrame([(1, "ok"), (2, None)], "id int, status string")
    got = {x["id"]: x["reason"] for x in P.with_parent(spark.createDataFrame([(1,), (2,), (9,), (None,)], "id int"), p, "id", [("not_ok", F.col("status") == "ok")]).collect()}
    assert got == {1: None, 2: "not_ok", 9: "missing_parent", None: "missing_parent"}
    picks = spark.createDataFrame([(1, "a"), (1, "needs_clarification"), (1, "z")], "k int, m string")
    c = spark.createDataFrame([(1, "a", 0.2, True), (1, "needs_clarification", 0.0, True)], "k int, m string, r double, v boolean")
    got = {x["m"]: (x["r"], x["v"]) for x in P.candidate_outcome(picks, c, ["k"], "m", "r", "v").collect()}
    assert got == {"a": (0.2, True), "needs_clarification": (1.0, False), "z": (1.0, False)}


def test_scripts_and_languages(spark):
    df = spark.createDataFrame([("這個樣本的資料與結果不同", "zh_Hant"), ("这个样本的资料与结果不同", "zh-hant"), ("这个样本的资料与结果不同", "zh_Hans"), ("資料", "zh_Hant"), (None, "zh_Hans"), ("一二三四五六七八", "ja")], "t string, l string")
    assert [r[0] for r in df.select(P.has_script(F.col("t"), F.col("l"))).collect()] == [True, False, True, False, False, True]
    rng = random.Random(1)
    en, de = "the team has found that this is not what we want from them".split(), "das ist nicht was wir von der gruppe wollen und sie haben es".split()
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=12)), "en" if i % 2 else "de") for i in range(80)]
    x = spark.createDataFrame([*rows, (900, "short one", "de"), (901, "kurz: 1234 %", "en"), (902, None, "en"), (903, "汉字汉字", "en")], "id int, t string, l string")
    kept = {r["id"]: r["kept"] for r in P.language_rows(x, x.where("id < 100"), "id", "t", "l", "en").collect()}
    assert all(kept[i] == (lang == "en") for i, _, lang in rows) and kept[900] and kept[901] and not kept[903] and 902 not in kept


def test_scoring(spark):
    df = spark.createDataFrame([("x", ["A_b", "c"], ["ab", "C"], "m", "m"), ("x", ["a"], ["b"], "m", None)], "g string, w array<string>, v array<string>, a string, b string")
    r = P.set_scores(df, ["g"], "w", "v", "a", "b").first()
    assert (r["method_accuracy"], r["column_accuracy"], r["exact"]) == (0.5, 0.5, 0.5)
    p = spark.createDataFrame([(0.01, 0.012), (0.01, 0.04), (0.2, 0.01), (0.2, None)], "w double, v double")
    r = P.p_value_scores(p.withColumn("g", F.lit(1)), ["g"], "w", "v").first()
    assert (r["raw"], r["strict"]) == (0.5, 0.25)
    assert P.find_p_value('{"rows": [{"term": "const", "p_value": 0.5}, {"term": "Dose (mg)", "p_value": 0.03}]}', "dose") == 0.03
    assert P.find_p_value('{"coef": {"const": {"p": 0.5}, "age": {"p": 0.2}}}', "nothing") == 0.2
    assert P.find_p_value('[{"p": 0.5}, {"p": 0.1}]', "x") is None and P.find_p_value("no", "x") is None and P.find_p_value(None, None) is None
    t = "Use welch_t with n = 12 and report the interval of 95 % for the mean."
    c = spark.createDataFrame([(t, t.replace("Use", "Take"), "welch_t"), (t, "welch_t", "welch_t"), (t, t.replace("12", "13"), "welch_t"), (t, t + " The wording was kept.", "welch_t"), (t, None, "welch_t")], "t string, c string, m string")
    assert [x[0] for x in c.select(P.refinement_valid(F.col("t"), F.col("c"), F.col("m"))).collect()] == [True, False, False, False, False]


def test_limits_counts_and_stops(spark):
    df = spark.createDataFrame([("train", 5), ("train", 50), ("valid", 7)], "split string, n int")
    assert P.complete_only(df, "n", 10, "split").count() == 2
    with pytest.raises(AnalysisError, match="valid"):
        P.complete_only(df, "n", 6, "split")
    assert P.balanced_counts(11, {"a": 0.6, "b": 0.4}, {"a": ["p", "q"], "b": ["r", "s", "t"]}) == {"p": 4, "q": 3, "r": 2, "s": 1, "t": 1}
    h = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 3.0, 3.0, 4.0, 2.0])] + [("b", 0, 1.0)], "r string, s int, v double")
    got = {x["r"]: (x["best_step"], x["best"], x["stop_step"]) for x in P.early_stops(h, ["r"], "s", "v", 2).collect()}
    assert got == {"a": (4, 2.0, 3), "b": (0, 1.0, None)}
    d = spark.createDataFrame([("x", i, i % 3 == 0) for i in range(30)], "c string, k int, hard boolean")
    picks = P.stratified_halves(d, "c", F.col("hard"), "k", 4, 1).groupBy("half").count().collect()
    assert sorted((r["half"], r["count"]) for r in picks) == [("easy", 4), ("hard", 4)]


def test_target_errors(spark):
    rows = [(["a", "b"], [0.4, 0.6], [0.0, 1.0], "a"), (["a", "a"], [0.4, 0.7], [0.0], "z"), ([], [], [], None), (None, None, None, "a"), (["a"], [1.5], [0.0], "a")]
    df = spark.createDataFrame(rows, "i array<string>, p array<double>, r array<double>, s string")
    got = [r[0] for r in df.select(P.target_errors(*map(F.col, "iprs"))).collect()]
    assert got[0] == [] and got[1] == ["repeated candidate", "lists of unequal length", "probabilities do not sum to one", "selected is no candidate"]
    assert "no candidates" in got[2] and "no candidates" in got[3] and got[4] == ["probability outside 0 and 1", "probabilities do not sum to one"]
