import pytest

from lodestat.operators.preprocess import AnalysisError
from lodestat.plans import compiler as K
from lodestat.plans.procedures import CATALOGUE, Request, outcome_of, run


def _survival():
    return [K.Column("weeks_in_use", "continuous", 88, 0, 0.5), K.Column("failed", "binary", 2, 0), K.Column("coating", "binary", 2, 0)]


def test_survival_roles():
    p = K.plans(_survival(), "Does the survival of pumps, weeks_in_use until failed, differ by coating?")[0]
    assert p.request.method_id == "logrank" and p.ready
    assert (p.request.roles["time"], p.request.roles["event"], p.request.roles["group"]) == ("weeks_in_use", "failed", "coating")


def test_named_method_and_clarification():
    cols = [K.Column("y", "continuous", 90, 0, 0.0), K.Column("g", "categorical", 3, 0)]
    assert K.plans(cols, "Run a kruskal wallis test of y by g")[0].request.method_id == "kruskal_wallis"
    assert K.choose(cols, "What now?") is None
    assert K.null_probability("is it 30 % or more") == 0.3 and K.alternative("is it greater") == "greater"


def test_analyze_runs_what_it_plans(spark):
    df = spark.createDataFrame([(float(i % 17), "ab"[i % 2]) for i in range(60)], "score double, arm string")
    r = K.analyze(df, "Does the mean score differ between the levels of arm?")
    assert r["status"] == "ok" and r["method_id"] == "welch_t" and r["result"][0]["n1"] == 30


def test_errors(spark):
    df = spark.createDataFrame([(1.0, "a")], "y double, g string")
    assert outcome_of(df, Request("welch_t", {"outcome": "y"}))["status"] == "error"
    assert outcome_of(df, Request("nope"))["status"] == "error"
    with pytest.raises(AnalysisError):
        run(df, Request("welch_t", {"outcome": "y", "group": "g"}, row_filters=({"column": "g", "operation": "include", "values": ["z"]},)))
    assert len(CATALOGUE) == 36


def test_declared_filters_and_recodes():
    cols = [K.Column("grade", "categorical", 3, 0, levels=("Oak", "Pine", "Teak")), K.Column("stored", "binary", 2, 0, levels=("damp", "dry")), K.Column("strength", "continuous", 90, 0, 3.0)]
    want = [{"column": "stored", "operation": "exclude", "values": ["damp"]}], [{"column": "grade", "positive_values": ["Teak"]}]
    for q in ("Drop damp boards. Is the mean strength another by grade, Teak against the rest?", "排除 damp 的木板。strength 的平均值在 grade 之間是否不同，Teak 對其餘？"):
        assert K.declared(cols, q) == want
        p = K.plans(cols, q)[0]
        assert p.request.method_id == "welch_t" and p.request.roles["group"] == "grade" and p.request.binary_recodes


def test_declared_steps_run(spark):
    rows = [(("Teak", "Oak", "Pine", None)[i % 4], "damp" if i % 5 == 0 else "dry", float(i % 13) + i / 50) for i in range(140)]
    df = spark.createDataFrame(rows, "grade string, stored string, strength double")
    r = K.analyze(df, "Drop damp. Is the mean strength another by grade, Teak against the rest?")
    assert r["status"] == "ok" and r["result"][0]["n1"] + r["result"][0]["n2"] == sum(g is not None and w == "dry" for g, w, _ in rows)


def test_rules_by_the_table():
    from lodestat.plans.rules import RULES, cues, scored

    assert {m for r in RULES for m in r.gives} <= set(CATALOGUE) and all(0 < v < 1 for r in RULES for v in r.gives.values())
    assert scored({"time", "event", "group", "outcome"}) == {"logrank": 0.99, "cox_ph": 0.78}
    assert scored({"time", "event", "group", "cue:adjust"}) == {"cox_ph": 0.97, "logrank": 0.68}
    assert scored({"outcome", "outcome:levels", "group", "group:levels", "outcome:two", "group:two", "sparse_table"})["fisher_exact"] == 0.91
    assert scored({"outcome"}) == {"conjugate_bayes": 0.45, "posterior_predictive": 0.42} and scored(set()) == {}
    assert {"rank", "association"} <= cues("兩者的等級相關") and cues("mean") == {"mean"} and "mean" not in cues("demeaned")
    few = [K.Column("cured", "binary", 2, 0, rows=40), K.Column("arm", "binary", 2, 0, rows=40)]
    assert K.plans(few, "Is cured tied to arm?")[0].request.method_id == "fisher_exact"


def test_glossary_context_and_repair(spark):
    text = "- `hrs`: hours to failure, continuous (running time)\n| wing | categorical, which hall |\nnothing here\nok - binary, \"passed\"\nhrs: again"
    g = K.parse_glossary(text)
    assert set(g) == {"hrs", "wing", "ok"} and g["hrs"].names == ("running time",) and (g["wing"].kind, g["ok"].kind) == ("categorical", "binary")
    cols = K.described([K.Column("hrs", "continuous", 50, 0), K.Column("wing", "continuous", 4, 0), K.Column("ok", "categorical", 3, 0)], g)
    assert [c.kind for c in cols] == ["continuous", "categorical", "categorical"]
    assert [c.name for c in K.mentioned(cols, "Does the running time differ by wing?")] == ["hrs", "wing"]
    assert K.study_context("A randomized trial, one row per patient") == {"design": "randomized", "unit": "patient"}
    assert K.study_context("觀察性研究") == {"design": "observational", "unit": None}
    bad = Request("welch_t", {"outcome": "a", "group": "a"})
    assert K.plan_errors([K.Column("a", "binary", 1, 0)], bad) == ["a has two roles", "a does not vary"]
    assert K.plan_errors([], Request("nope")) == ["unknown procedure: nope"]
    df = spark.createDataFrame([(float(i), "x") for i in range(30)], "v double, g string")
    assert K.analyze(df, "Does the mean v differ by g?")["status"] in ("needs_clarification", "error")


def test_settings_and_command_line(tmp_path, capsys):
    from lodestat.__main__ import main, parser
    from lodestat.config import load_settings

    p = tmp_path / "s.toml"
    p.write_text("schema_version = 1\n[inputs]\nmost = 2\n")
    assert load_settings(str(p)).section("inputs") == {"most": 2}
    with pytest.raises(KeyError):
        load_settings(str(p)).section("other")
    for text in ("schema_version = 2\n", "schema_version = 1\nx = 3\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            load_settings(str(p))
    assert main(["queries"]) == 0 and "welch_t" in capsys.readouterr().out
    assert parser().parse_args(["analyze", "--data", "a.csv", "--data", "b.csv", "--question", "q"]).data == ["a.csv", "b.csv"]
