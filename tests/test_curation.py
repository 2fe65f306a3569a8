import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators import curate as U
from lodestat.operators import evaluate as E
from lodestat.operators import policy as O
from lodestat.operators import router as R
from lodestat.operators.preprocess import AnalysisError
from lodestat.sources import files
from lodestat.streaming import incremental as S


def test_quotas_and_split(spark):
    assert U.quotas(50, [("train", 90), ("valid", 5), ("test", 5)]) == {"train": 44, "valid": 3, "test": 3}
    df = spark.createDataFrame([("lot 77/b",)] * 2, "id string")
    got = {r[0] for r in df.select(U.hash_split(F.col("id"), 42, [("train", 90), ("valid", 5), ("test", 5)])).collect()}
    assert len(got) == 1 and got <= {"train", "valid", "test"}


def test_budget_trim_against_greedy(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id bigint, n bigint")
    for repeats, pool in ((1, 10_000), (3, 10_000), (3, 4)):
        got = sorted(tuple(r) for r in U.budget_trim(df, ["g"], "id", "n", 700, repeats, pool=pool).select("g", "id", "repeat_index").collect())
        order = {r["id"]: r["h"] for r in df.select("id", U.digest_order(0, "id").alias("h")).collect()}
        want = []
        for g in "ab":
            left, first = 700, True
            for rep in range(repeats):
                for _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: order[r[1]]):
                    if n <= left or first:
                        want.append((g, i, rep))
                        left -= n
                        first = False
        assert got == sorted(want)


def test_slices_by_value_are_even(spark):
    from lodestat.operators.ordering import value_slices

    d = spark.range(40_000).select(F.exp(4 * F.randn(3)).alias("v")).union(spark.createDataFrame([(float("inf"),), (0.0,)], "v double"))
    x, at = value_slices(d, "v", 64)
    most = x.groupBy(at.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()
    assert max(r["n"] for r in most) < 1500 and all(a["hi"] < b["lo"] for a, b in zip(most, most[1:]))
    assert value_slices(d.where("false"), "v")[0].count() == 0


def test_duplicates_and_overlap_use_compatibility_forms(spark):
    docs = spark.createDataFrame([(1, "Ａ  b ｃ d"), (2, "a B c D"), (3, None), (4, "x")] + [(10 + i, "same") for i in range(30)], "id int, t string")
    got = {r["id"]: r["kept_key"] for r in U.exact_duplicates(docs.where("t IS NOT NULL"), "id", "t").collect()}
    assert got[1] == got[2] == 1 and got[4] == 4 and {got[10 + i] for i in range(30)} == {10}
    refs = spark.createDataFrame([(1, "ａ b c")], "r int, u string")
    assert {r["id"] for r in U.ngram_overlap(docs, refs, "id", "t", "r", "u", 2).where("best_ratio > 0").collect()} == {1, 2}


def test_chat_errors(spark):
    msg = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    schema = T.StructType([T.StructField("messages", msg), T.StructField("metadata", T.StructType([T.StructField("a", T.StringType())]))])
    df = spark.createDataFrame([([("user", "q"), ("assistant", "a")], ("x",)), ([("assistant", " ")], (None,)), (None, None)], schema)
    got = [r[0] for r in df.select(U.chat_errors(F.col("messages"), F.col("metadata"), ["a"])).collect()]
    assert got[0] == [] and len(got[1]) == 4 and "fewer than two messages" in got[2]


def test_largest_remainder_and_tokens(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0)], "k string, w double")
    assert {r["k"]: r["n"] for r in U.largest_remainder(df, "k", "w", 30).collect()} == {"a": 13, "b": 9, "c": 8}
    t = spark.createDataFrame([([0.7, -2.0, 0.0, 1.5, 0.4, -0.3, 0.6],)], "d array<double>")
    got = t.select(U.selected_tokens(F.col("d"), 11, 0.5, 0.0)).first()[0]
    assert got == [10, 13, 15, 16]


def test_overlap(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, None)], "id int, t string")
    refs = spark.createDataFrame([(1, "a b c"), (2, "c d")], "r int, u string")
    got = {r["id"]: (r["union_ratio"], r["best_ratio"]) for r in U.ngram_overlap(docs, refs, "id", "t", "r", "u", 2).collect()}
    assert got == {1: (1.0, pytest.approx(2 / 3)), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_router(spark):
    rows = [(i, "the mean of groups differs", "stats") for i in range(10)] + [(i + 10, "def f(x): return x", "code") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    m = R.fit(df, "id", "t", "c")
    s = R.score(spark.createDataFrame([(1, "mean of the group"), (2, "return f(x)"), (3, "")], "id int, t string"), m, "id", "t").collect()
    got = {r["id"]: r["predicted"] for r in s}
    assert got[1] == "stats" and got[2] == "code" and got[3] in ("stats", "code")


def test_evaluation(spark):
    d = spark.createDataFrame([(str(i), 0.1 + (i % 5) / 100) for i in range(200)], "k string, d double")
    a, b = (E.paired_bootstrap(d, "d", "k", draws=300).first() for _ in range(2))
    assert a == b and a["ci_low"] < a["mean"] < a["ci_high"]
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    c = spark.createDataFrame([("a", 1.005), ("c", 1.0)], "k string, v double")
    assert {r["k"]: r["passed"] for r in E.non_inferiority(p, c, ["k"], "v", 0.01).collect()} == {"a": True, "b": False, "c": False}
    assert E.power_sample_size(0.1, 0.5, multiple=50) % 50 == 0
    with pytest.raises(ValueError):
        E.power_sample_size(0.0, 1.0)


def test_policy_invariants(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(s, m, rng.random()) for s in range(20) for m in "abc"], "s int, m string, v double")
    r = O.softmax(O.normalised(df, ["s"], "v").withColumn("g", -F.col("regret")), ["s"], "g", 0.15)
    q = O.projected(r, ["s"], "probability", "regret")
    t = q.groupBy("s").agg(F.sum("probability").alias("p"), F.sum("projected").alias("q"), F.sum(F.col("projected") * F.col("regret") - F.col("probability") * F.col("regret")).alias("gain"), F.min("regret").alias("lo"), F.max("regret").alias("hi"))
    for x in t.collect():
        assert x["p"] == pytest.approx(1) and x["q"] == pytest.approx(1) and x["gain"] <= 1e-9 and (x["lo"], x["hi"]) == (0, 1)
    back = O.regret_of(r, ["s"], "probability", 0.15, "again")
    assert all(abs(x["again"] - x["regret"]) < 1e-9 for x in back.collect())
    b = spark.createDataFrame([("f", "n", 2.0, 100.0, True), ("f", "e", 0.0, 1.0, False)], "family_id string, parameter_name string, lower_bound double, upper_bound double, is_integer boolean")
    pts = [r["parameters"] for r in O.latin_hypercube(spark, b, 20).collect()]
    assert sorted(int(p["e"] * 20) for p in pts) == list(range(20))


def test_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"x')], "id int, t string")
    files.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "x.csv")).collect())) == [(1, "a,b"), (2, 'q"x')]
    (tmp_path / "doc.json").write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert files.read_table(spark, str(tmp_path / "doc.json")).count() == 2
    with pytest.raises(AnalysisError):
        files.read_table(spark, "x.xlsx")
    assert files.read_records(spark, str(tmp_path / "none.jsonl"), df.schema).count() == 0
    files.write_records(df, str(tmp_path / "r"))
    assert files.read_records(spark, str(tmp_path / "r"), df.schema).count() == 2
    assert len(files.file_digests(spark, str(tmp_path / "doc.json")).first()["sha256"]) == 64
    assert files.fingerprint({"b": 1, "a": 2}) == files.fingerprint({"a": 2, "b": 1})
    m = str(tmp_path / "m.json")
    for _ in range(2):
        files.write_manifest(spark, m, {"a": 1})
    assert files.read_manifest(spark, m) == {"a": 1} and files.read_manifest(spark, m + "x") is None
    made = [files.unless_done(spark, m, {"v": v}, lambda: {"files": []})[1] for v in (1, 1, 2)]
    assert made == [True, False, True]
    none = files.file_digests(spark, str(tmp_path / "doc.json")).where("false")
    files.check_shard(spark, m, none, {"v": 2})
    with pytest.raises(AnalysisError):
        files.check_shard(spark, m, none, {"v": 1})
    assert files.check_inputs(spark, [m]) == [m]
    for bad in ([], [m] * 4, ["x.exe"], [m + "l"]):
        with pytest.raises(AnalysisError):
            files.check_inputs(spark, bad)
    with pytest.raises(AnalysisError):
        files.check_inputs(spark, [m], most_bytes=3)
    lines = spark.createDataFrame([(1, "a\nb")], "id int, t string")
    files.write_csv(lines, str(tmp_path / "n.csv"))
    assert files.read_table(spark, str(tmp_path / "n.csv"), lines.schema, multi_line=True).first()["t"] == "a\nb"
    df.write.parquet(str(tmp_path / "in"))
    s = S.file_stream(spark, str(tmp_path / "in"), df.schema)
    for _ in range(2):
        S.append_batches(s, str(tmp_path / "out"), str(tmp_path / "ck"), "id").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    df.withColumn("id", F.col("id") + 10).write.mode("append").parquet(str(tmp_path / "in"))
    assert S.run_for(S.append_batches(s, str(tmp_path / "out"), str(tmp_path / "ck"), "id"), 60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_small_numeric_choices():
    import numpy as np

    from lodestat.operators import selection as L

    v = np.array([[1.0, 0.0], [0.0, 2.0]])
    w = L.min_norm_weights(v @ v.T)
    assert w == pytest.approx([0.8, 0.2], abs=1e-4)
    s = L.conflict_summary(np.array([[1.0, -0.5], [-0.5, 1.0]]))
    assert s["negative_share"] == 1 and 1 < s["effective_rank"] <= 2
    assert L.z_from_p(0.05) == pytest.approx(1.959964, abs=1e-5)
    assert L.smooth_schedule({"a": 2, "b": 1}, 6).count("a") == 4


def test_menu_and_mutation(spark):
    from lodestat.operators import selection as L

    df = spark.createDataFrame([(1, ["x", "y"], {"n": 10.0, "e": 0.5, "z": 3.0})], "id int, c array<string>, p map<string,double>")
    r = df.select(L.menu(F.col("c"), F.col("id")).alias("m"), L.mutated(F.col("p"), F.col("id"), F.expr("map('n', 2.0d, 'e', 0.0d)"), F.expr("map('n', 100.0d, 'e', 1.0d)"), F.expr("map('n', true, 'e', false)")).alias("q")).first()
    assert [x["label"] for x in r["m"]] == ["A", "B", "C"] and {x["method"] for x in r["m"]} == {"x", "y", "needs_clarification"}
    assert r["q"]["z"] == 3.0 and r["q"]["n"] == round(r["q"]["n"])
    many = spark.range(400).select("id", F.expr("map('n', 10.0d, 'e', 0.5d, 'z', 3.0d)").alias("p"))
    moved = [x[0] for x in many.select(L.mutated(F.col("p"), F.col("id"), F.expr("map('n', 2.0d, 'e', 0.0d)"), F.expr("map('n', 100.0d, 'e', 1.0d)"), F.expr("map('n', true, 'e', false)"))).collect()]
    both = sum(m["n"] != 10.0 and m["e"] != 0.5 for m in moved)
    assert all(m["e"] == 0.5 or 0.04 <= abs(m["e"] - 0.5) <= 0.18 for m in moved) and all(m["n"] != 10.0 or m["e"] != 0.5 for m in moved) and 0.25 < both / 400 < 0.45


def test_mmr_looks_at_the_whole_group(spark):
    rng = random.Random(3)
    rows = []
    for g in ("a", "b", None):
        same = " ".join(rng.choice("pqrst") for _ in range(12))
        rows += [(g, f"{g}{i:02}", same + (" u v w" if i % 3 else ""), round(0.9 - i / 1000, 2)) for i in range(40)]
        rows += [(g, f"{g}x{i}", " ".join(rng.choice("pqrstuvwxyz") for _ in range(12)), round(0.8 - i / 100, 2)) for i in range(8)]
    rows += [("few", "f1", "one two", 0.1), ("few", "f2", None, 0.1)]
    df = spark.createDataFrame(rows, "g string, id string, t string, s double")
    want = {}
    for g in ("a", "b", None, "few"):
        own = sorted((-s, i) for h, i, t, s in rows if h == g)
        relevance = {i: 1 - k / (len(own) - 1) for k, (_, i) in enumerate(own)}
        left = [(i, frozenset(zip(*[(t or "").split()[n:] for n in range(3)])), relevance[i]) for h, i, t, _ in rows if h == g]
        chosen = []
        while left and len(chosen) < 10:
            near = lambda x: max((len(x & y) / len(x | y) if x | y else 0.0 for _, y, _ in chosen), default=0.0)  # noqa: B023, E731
            best = max(left, key=lambda r: (r[2] - 0.35 * near(r[1]), r[0]))
            want[g, len(chosen) + 1] = (best[0], pytest.approx(best[2] - 0.35 * near(best[1])))
            left.remove(best)
            chosen.append(best)
    for pool in (4, 400):
        got = {(r["g"], r["position"]): (r["id"], r["mmr"]) for r in U.mmr(df, "g", "id", "t", "s", 10, pool=pool).collect()}
        assert got == want


def _routed(spark, folder, rows):
    from lodestat.queries.text import text_router_nb

    spark.createDataFrame(rows, "canary_row bigint, text string, family_id string").write.parquet(str(folder / "routing_canary.parquet"))
    return {(r["label"], r["predicted"]): r["n"] for r in text_router_nb(spark, str(folder)).collect()}


def test_router_query_has_the_whole_vocabulary(spark, tmp_path):
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(3000))  # over 3000 features in every text
    rows = [(i, f"{common} {i} {'uvuv' if i % 2 else 'wzwz'}", "odd" if i % 2 else "even") for i in range(40)]
    rows = [(i, t.replace(f" {i} ", f" {chr(0x4E00 + i)} "), f) for i, t, f in rows]
    assert set(_routed(spark, tmp_path, rows)) == {("odd", "odd"), ("even", "even")}


def test_router_query_reads_long_texts_to_the_end(spark, tmp_path):
    rows = [(i, "a" * 100_000 + f" {chr(0x4E00 + i)} {'uvuv' if i % 2 else 'wzwz'}", "odd" if i % 2 else "even") for i in range(16)]
    assert set(_routed(spark, tmp_path, rows)) == {("odd", "odd"), ("even", "even")}


@pytest.mark.parametrize("caps", [(3, 4), (None, 2), (2, None), (None, None)])
def test_capped_picks_against_the_rule(spark, caps):
    from lodestat.operators import selection as L

    rng = random.Random(sum(c or 0 for c in caps))
    rows = [(i, rng.choice("fgh"), rng.choice("mno"), round(rng.random(), 2)) for i in range(60)]
    got = [r["id"] for r in L.capped_picks(spark.createDataFrame(rows, "id int, f string, m string, r double"), "f", "m", "id", "r", 9, *caps).orderBy("rank").collect()]
    left, want = sorted(rows, key=lambda r: (-r[3], r[0])), []
    free = lambda r: all(c is None or sum(w[k] == r[k] for w in want) < c for k, c in zip((1, 2), caps))
    for f in "fgh":
        first = next((r for r in left if r[1] == f and free(r)), None)
        want += [first] if first else []
    for r in left:
        if len(want) < 9 and r not in want and free(r):
            want.append(r)
    assert got == [r[0] for r in want]


def test_nearest_in_blocks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("fg"), {"a": rng.random(), "b": rng.random() * 10} if i % 9 else {"a": rng.random()}) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, f string, p map<string,double>")
    w = {"f": {"a": 1.0, "b": 10.0}, "g": {"a": 1.0, "b": 10.0}}
    for largest in (False, True):
        got = {r["key"]: (r["novelty"], r["nearest"]) for r in O.nearest(df.where("id < 20"), df, "f", "id", "p", w, largest, 5).collect()}
        for i, f, p in rows[:20]:
            far = lambda q: [abs(p[k] - q[k]) / v if k in p and k in q else 1.0 for k, v in w[f].items()]  # noqa: B023, E731
            d = {j: max(far(q)) if largest else (sum(x * x for x in far(q)) / 2) ** 0.5 for j, g, q in rows if g == f and j != i}
            assert got[i] == (pytest.approx(min(d.values())), min(d, key=lambda j: (d[j], j)))


def test_targets_and_losses(spark):
    df = spark.createDataFrame([(1, "a", 0.6, 0.1, 0.9, False, "repair"), (1, "b", 0.4, 0.9, 0.1, True, "repair"), (2, "a", 0.6, 0.1, 0.9, False, "anchor"), (2, "b", 0.4, 0.9, 0.1, True, "anchor")], "k int, method string, p double, q double, r double, valid boolean, role string")
    t = O.triggered_target(df, ["k"], "p", "q", "r", "valid", "role", 0.2, 0.1, 0.5, 0.4).collect()
    pull = {r["k"]: r["pull"] for r in t}
    assert pull == {1: pytest.approx(0.4), 2: 0.0}  # the climb gives .1 + .4 * (.58 - .2) / .8 = .29, an invalid choice at least .4
    assert all(sum(r["target"] for r in t if r["k"] == k) == pytest.approx(1) for k in (1, 2))
    kept = O.kept_if_no_worse(O.triggered_target(df, ["k"], "p", "q", "r", "valid", "role", 0.2, 0.1, 0.5, 0.4), ["k"], "p", "target", "r")
    assert all(r["taken"] for r in kept.collect())
    x = spark.createDataFrame([([2.0, 1.0, 3.0], [1.0, 2.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "s array<double>, t array<double>").select(O.excess_loss(F.col("s"), F.col("t")).alias("e")).collect()
    assert x[0]["e"]["mass"] == pytest.approx(1.0) and x[0]["e"]["utility"] == pytest.approx(1.0 / (1 + 4 / 3) + 0.04) and x[1]["e"] is None and x[2]["e"] is None


def test_text_rules(spark):
    from lodestat.functions import text as X

    rows = ["What is a median?", "用中位數？", "write a python function", "see ```x```", "the class of patients", "The report is def final", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(X.route(F.col("t"))).collect()] == ["base", "adapter", "adapter", "adapter", "base", "base", "base"]
    assert {r[0] for r in df.select(X.route(F.col("t"), " Base ")).collect()} == {"base"}
    with pytest.raises(Exception, match="unknown route"):
        df.select(X.route(F.col("t"), "elsewhere")).collect()
    assert [r[0] for r in df.select(X.statistics_route(F.concat(F.col("t"), F.lit(" regression")), F.lit(0))).collect()][:2] == ["stats", "stats"]
    assert df.select(X.statistics_route(F.lit("hi"), F.lit(2))).first()[0] == "stats" and df.select(X.statistics_route(F.lit("hi"), F.lit(0), "adapter")).first()[0] == "stats"
    m = spark.createDataFrame([("a $$y=2$$ then $x = 1$ and \\(z=3\\) `k` ```c\nd``` 5",), ("plain",), ("",)], "t string")
    text, spans = X.protect(F.col("t"), "q")
    p = m.select("t", text.alias("p"), spans.alias("s"))
    got = p.select("t", "p", "s", X.restored(F.col("p"), F.col("s"), "q").alias("back"), X.restored(F.regexp_replace("p", "<CA_q_0001>", ""), F.col("s"), "q").alias("lost")).collect()
    assert all(r["back"] == r["t"] for r in got) and got[0]["lost"] is None and got[1]["lost"] == "plain" and len(got[0]["s"]) == 5 and "$" not in got[0]["p"]
    assert m.select(X.formulas(F.col("t"))).first()[0] == ["y=2", "x=1", "z=3"]
    v = spark.createDataFrame([([0, 3, 7, 7], [3, 7, 7, 9])], "a array<int>, b array<int>")
    assert v.select(X.interval_mask(F.col("a"), F.col("b"), F.lit(2), F.lit(7))).first()[0] == [True, True, False, False]
    assert [r[0] for r in spark.createDataFrame([(1,), (33,), (500,)], "n int").select(X.padding_bucket(F.col("n"), [64, 32])).collect()] == [32, 64, None]
    assert df.select(X.strip_label(F.lit("Problem 3. What?"))).first()[0] == "What?" and df.select(X.strip_label(F.lit("3 apples"))).first()[0] == "3 apples"


def test_guards_and_choices(spark):
    from lodestat.operators import gates as G

    df = spark.createDataFrame([("x", i % 2 == 0, i / 20) for i in range(20)] + [("y", True, 0.9), ("y", False, 0.2)], "g string, t boolean, s double")
    grid = {r["threshold"]: r for r in G.guard_grid(df, F.col("t"), F.col("s"), ["g"], [0.1, 0.5, 0.95]).collect()}
    assert grid[0.5]["min_sensitivity"] == 0.5 and grid[0.95]["min_sensitivity"] == 0.0 and grid[0.1]["sensitivity"] == round(10 / 11, 6)
    best = G.eligible_best(G.guard_grid(df, F.col("t"), F.col("s"), ["g"], [0.1, 0.5, 0.95]), {"quiet": F.col("specificity") >= 0.4}, [F.desc("sensitivity"), F.col("threshold")]).collect()
    assert {r["threshold"]: (r["passed"], r["chosen"]) for r in best} == {0.1: (False, False), 0.5: (True, True), 0.95: (True, False)}
    with pytest.raises(Exception, match="only one side"):
        E.paired(df.select("g", "s").distinct(), df.where("g = 'x'").select("g", "s").distinct(), ["g"], "s", whole=True).collect()


def test_menu_loses_no_option(spark):
    from lodestat.operators import selection as L

    df = spark.createDataFrame([(1, list("uvwxy")), (2, list("uvwxyz"))], "id int, c array<string>")
    got = {r["id"]: r["m"] for r in df.select("id", L.menu(F.col("c"), F.col("id")).alias("m")).collect()}
    assert [x["label"] for x in got[1]] == list("ABCDEF") and got[2] is None


def test_nearest_by_cells_with_missing_equal_and_unknown(spark):
    """Many equal references, missing parameters and ties; a family without ranges has no distance, as in SQL."""
    rng = random.Random(3)
    rows = [(i, "f", {k: float(rng.randrange(5)) for k in "abc" if rng.random() > 0.1}) for i in range(400)] + [(400 + i, "f", {"a": 1.0, "b": 1.0, "c": 1.0}) for i in range(200)]
    rows += [(1000, "unknown", {"a": 1.0}), (1001, "unknown", {"a": 2.0})]
    df = spark.createDataFrame(rows, "id bigint, f string, p map<string,double>")
    w = {"f": {"a": 4.0, "b": 4.0, "c": 4.0}}
    points = [r for r in rows if r[0] % 11 == 0 or r[0] >= 1000]
    for largest in (False, True):
        got = {r["key"]: (r["novelty"], r["nearest"]) for r in O.nearest(df.where("id % 11 = 0 OR id >= 1000"), df, "f", "id", "p", w, largest, 8).collect()}
        assert set(got) == {r[0] for r in points if r[1] == "f"}
        for i, _, p in [r for r in points if r[1] == "f"]:
            far = lambda q: [abs(p[k] - q[k]) / 4 if k in p and k in q else 1.0 for k in "abc"]  # noqa: B023, E731
            d = {j: max(far(q)) if largest else (sum(x * x for x in far(q)) / 3) ** 0.5 for j, g, q in rows if g == "f" and j != i}
            assert got[i] == (pytest.approx(min(d.values())), min(d, key=lambda j: (d[j], j)))


def test_novelty_sends_no_pairs_through_a_shuffle(spark):
    """Pairs of points and references stay in a task; what is joined by keys has a line per point."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "f", {"a": rng.random(), "b": rng.random()}) for i in range(3000)], "id bigint, f string, p map<string,double>")
    out = O.novelty(df.where("id % 100 = 0"), df, "f", "id", "p", {"f": {"a": 1.0, "b": 1.0}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "block" not in plan
    at = {r["id"]: r["p"] for r in df.collect()}
    for r in out.collect():
        p = at[r["key"]]
        want = min((((p["a"] - q["a"]) ** 2 + (p["b"] - q["b"]) ** 2) / 2) ** 0.5 for j, q in at.items() if j != r["key"])
        assert r["novelty"] == pytest.approx(want)


def test_overlap_of_shared_texts_by_classes(spark, monkeypatch):
    """Templates shared by many documents and references meet as classes, in several blocks, with the result of all pairs."""
    from lodestat.operators import grams as G

    monkeypatch.setattr(G, "MEET", 16)
    rng = random.Random(9)
    made = lambda: f"the arms of site {rng.randrange(6)} were {rng.choice('abc')} by a factor of {rng.randrange(6)} here"
    docs, refs = [(i, made()) for i in range(400)], [(i, made()) for i in range(300)] + [(300, None)]
    cut = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    of = [cut(t) for _, t in refs if t]
    got = U.ngram_overlap(spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(refs, "r int, u string"), "id", "t", "r", "u", 3).collect()
    assert len(got) == 400
    for r in got:
        g = cut(docs[r["id"]][1])
        assert r["n_grams"] == len(g) and r["union_ratio"] == pytest.approx(len(g & set().union(*of)) / len(g)) and r["best_ratio"] == pytest.approx(max(len(g & x) for x in of) / len(g))


def test_digests_count_the_same_ngrams_as_the_column_form(spark):
    from lodestat.functions import text as X
    from lodestat.operators import grams as G

    rows = [None, "", " ", "a", "a b", "a b a b a b", "ＡΣ b\tc  d ΑΣ　x", "é é é é", "x\x0by\x0cz x y z", "没有 人 确认 没有 人"]
    d = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", "t", X.normalize_text(F.col("t")).alias("text"))
    full = b"\xff" * (1 << (G.BITS - 3))
    for n in (1, 2, 4):
        want = {r["id"]: len(r["g"]) for r in d.select("id", X.word_ngrams(F.col("t"), n).alias("g")).collect()}
        got = G.digest_sets(d, "id", "text", n, full).collect()
        assert {r["id"]: r["n_grams"] for r in got} == want == {r["id"]: len(r["hits"]) // 16 for r in got}


def test_bitmap_lets_hardly_anything_pass_that_is_not_there(spark):
    """A bitmap with one bit a digest let about every tenth digest pass here, and with it most texts, though nothing is shared."""
    from lodestat.operators import grams as G

    word = lambda tag, i: f"{tag}{i}"
    refs = spark.createDataFrame([(" ".join(word("r", 35_000 * k + i) for i in range(35_000)),) for k in range(200)], "u string")
    docs = spark.createDataFrame([(k, " ".join(word("d", 50 * k + i) for i in range(50))) for k in range(2000)], "id int, t string")
    bits = G.bitmap_of_texts(refs.repartition(8), 1)
    got = G.digest_sets(docs, "id", "t", 1, bits).collect()
    assert len(got) == 2000 and all(r["n_grams"] == 50 for r in got)
    assert sum(len(r["hits"]) // 16 for r in got) < 3000


def test_words_of_a_text_are_those_of_the_normalised_text(spark):
    from lodestat.functions import text as X
    from lodestat.operators import grams as G

    rows = [f"a{chr(i)}B {chr(i)}" for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).lower() != chr(i) or chr(i).isspace() or i < 0x300 or i in G._LOWER)]
    rows += [None, "", "ΑΣ ΟΔΟΣ.", "\tＡ\u3000Ⅻ\x0bfi\ufb01 \r\n x\u00a0y\x1cz", "İI ẞ"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.normalize_text(F.col("t")).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert G.split_words(r["t"]) == [w.encode() for w in (r["n"] or "").split(" ") if w]


def test_equal_ngrams_of_a_text_count_once_whatever_their_digests(monkeypatch):
    """With first numbers that are all equal, the second ones tell the n-grams apart; no n-gram goes over a text's end."""
    from lodestat.operators import grams as G

    texts = ["a b a b a b", None, "", "a", "b a", "x y z x y z x", "a b"]
    for blunt in (False, True):
        d = G.Digests(2)
        if blunt:
            d.factors[:, 0] = 0
        g = d.of(texts)
        assert g.owner.tolist() == [0, 0, 4, 5, 5, 5, 6]
        h = [tuple(x) for x in g.whole(np.arange(7)).tolist()]
        assert len(set(h)) == 5 and h[6] in h[:2] and h[2] in h[:2]
    assert len(d.of([]).owner) == len(d.of(["a", None]).owner) == 0
