import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.operators import preprocess as P
from lodestat.operators.profile import profile
from lodestat.operators.stats import compare as C
from lodestat.operators.stats import longitudinal as L
from lodestat.operators.stats import models as M


def test_distributions():
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert dist.beta_ppf(0.5, 2, 2) == pytest.approx(0.5, abs=1e-12)
    assert dist.gamma_sf(1.0, 1.0) == pytest.approx(math.exp(-1))


def test_binomial(spark):
    df = spark.createDataFrame([("no",)] * 2 + [("yes",)] * 6, "event string")
    r = C.binomial_test(df, "event").first()
    assert (r["n"], r["successes"], r["estimate"]) == (8, 6, 0.75)
    assert r["p_value"] == pytest.approx(74 / 256)
    for side, k in (("ci_low", 6), ("ci_high", 7)):  # Clopper-Pearson: the tail at the bound is 2.5 %
        tail = sum(math.comb(8, j) * r[side] ** j * (1 - r[side]) ** (8 - j) for j in range(k, 9))
        assert tail == pytest.approx(0.025 if side == "ci_low" else 0.975)


def test_small_exact_laws(spark):
    from itertools import combinations

    rng = random.Random(6)
    for m, n in ((2, 3), (3, 5), (4, 4)):
        every = [sum(c) - m * (m + 1) / 2 for c in combinations(range(1, m + n + 1), m)]
        for u in range(m * n + 1):
            want = min(1.0, 2 * sum(v >= max(u, m * n - u) for v in every) / len(every))
            assert C.exact_u_tail(u, m, n) == pytest.approx(want)
    v = rng.sample(range(1000), 9)
    df = spark.createDataFrame([(float(x), "a" if i < 4 else "b") for i, x in enumerate(v)], "v double, g string")
    r = C.mann_whitney(df, "v", "g").first()
    assert r["exact"] and r["statistic"] == sum(a > b for a in v[:4] for b in v[4:])
    assert not C.mann_whitney(df.union(df), "v", "g").first()["exact"]
    assert L.hypergeometric(np.random.default_rng(1), 7 * 10**8, 7 * 10**8, 1000, 2000).mean() == pytest.approx(500, abs=2)
    sizes = [5, 0, 9, 4]
    take = L._shares(np.random.default_rng(2), sizes, 7, 3000)
    assert (take.sum(1) == 7).all() and (take <= np.array(sizes)).all() and take.mean(0) == pytest.approx([35 / 18, 0, 63 / 18, 28 / 18], abs=0.08)


def test_array_functions():
    x = np.array([1e-3, 0.3, 1.0, 2.5, 7.7, 60.0, 1e4])
    assert M._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
    z = np.array([-6.0, -3.1, -0.2, 0.0, 0.5, 2.9, 3.0, 3.1, 6.0, 20.0, 40.0])
    assert M._erfc(z) == pytest.approx([math.erfc(v) for v in z], rel=1e-9)


def test_fisher_against_the_whole_law():
    rng = random.Random(4)
    for _ in range(200):
        a, b, c, e = (rng.randrange(0, 30) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + e
        p = {k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, col - n + row), min(row, col) + 1)}
        assert C.fisher_p(a, b, c, e) == pytest.approx(min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))))
    assert C.fisher_p(10**6, 10**6, 10**6, 10**6 + 9) > 0.98 and C.fisher_p(10**6, 10**6, 10**6, 2 * 10**6) < 1e-300


def test_exact_median(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 1000, 5001):
        v = [math.exp(rng.gauss(0, 3)) if i % 3 else 1.0 for i in range(n)]
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert M.exact_median(df, "v", 200) == pytest.approx(float(np.median(v)))
    assert M.exact_median(df.where("false"), "v") == 0.0


def test_held_out_scores_are_stratified(spark):
    df, *_ = _data(spark)
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    r = L.held_out_scores(keyed, "b", ["x"], "id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    assert len(r) == 5 and max(x["p"] for x in r) - min(x["p"] for x in r) <= 1 and max(x["n"] for x in r) - min(x["n"] for x in r) <= 2
    assert L.calibration_curve(keyed, "b", ["x"], "id").count() == 10


def test_filters_keep_nulls_on_exclude(spark):
    df = spark.createDataFrame([("oak", 1), (None, 2), ("elm", 3)], "status string, aux int")
    assert P.row_filters(df, [{"column": "status", "operation": "exclude", "values": ["elm"]}]).count() == 2
    assert P.row_filters(df, [{"column": "status", "operation": "include", "values": ["elm"]}]).count() == 1
    assert [r[0] for r in P.recode_binary(df, [{"column": "status", "positive_values": ["oak"]}]).orderBy("aux").select("status").collect()] == [1, None, 0]
    with pytest.raises(P.AnalysisError):
        P.row_filters(df, [{"column": "nope", "operation": "include", "values": [1]}])
    with pytest.raises(P.AnalysisError):
        P.two_levels(df, "aux")


def test_fisher_tea(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "y")] * 3
    r = C.fisher_exact(spark.createDataFrame(rows, "g string, o string"), "g", "o").first()
    assert r["odds_ratio"] == 9 and r["p_value"] == pytest.approx(0.4857142857)


def _data(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    g = rng.integers(0, 3, n)
    y = 1 + 2 * x + 0.5 * g + rng.normal(size=n) * (1 + 0.5 * (x > 0))
    b = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x)))).astype(int)
    c = rng.poisson(np.exp(0.2 + 0.4 * x))
    rows = [(float(x[i]), "abc"[g[i]], float(y[i]), int(b[i]), int(c[i]), int(i % 20)) for i in range(n)]
    return spark.createDataFrame(rows, "x double, g string, y double, b int, c int, k int"), x, g, y, b, c


def test_regressions_against_numpy(spark):
    df, x, g, y, b, c = _data(spark)
    X = np.column_stack([np.ones_like(x), x, g == 1, g == 2]).astype(float)
    want = np.linalg.lstsq(X, y, rcond=None)[0]
    rows = {r["term"]: r for r in M.ols(df, "y", ["x", "g"]).collect()}
    assert [rows[t]["estimate"] for t in ("const", "x", "g_b", "g_c")] == pytest.approx(list(want))
    e = y - X @ want
    inv = np.linalg.inv(X.T @ X)
    assert rows["x"]["std_error"] == pytest.approx(math.sqrt(e @ e / (len(y) - 4) * inv[1, 1]))
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv
    assert {r["term"]: r["std_error"] for r in M.ols(df, "y", ["x", "g"], "hc3").collect()}["x"] == pytest.approx(math.sqrt(hc3[1, 1]))
    # the score is zero at the fit
    for fit, t in ((M.logistic_glm, b), (M.poisson_glm, c)):
        est = {r["term"]: r["estimate"] for r in fit(df, "b" if fit is M.logistic_glm else "c", ["x"]).collect()}
        eta = est["const"] + est["x"] * x
        mu = 1 / (1 + np.exp(-eta)) if fit is M.logistic_glm else np.exp(eta)
        assert abs(np.sum(t - mu)) < 1e-5 and abs(np.sum(x * (t - mu))) < 1e-5


def test_likelihood_fits_are_at_their_maximum(spark):
    df, x, g, y, b, c = _data(spark)
    r = {t["term"]: t for t in M.probit_glm(df, "b", ["x"]).collect()}

    def ll(a, s):
        p = np.array([1 - dist.norm_sf(v) for v in a + s * x])
        return np.sum(np.where(b == 1, np.log(p), np.log(1 - p)))

    a, s = r["const"]["estimate"], r["x"]["estimate"]
    assert all(ll(a, s) >= ll(a + da, s + ds) - 1e-9 for da in (-0.01, 0, 0.01) for ds in (-0.01, 0, 0.01))
    cens = df.withColumn("y", F.greatest("y", F.lit(0.0)))
    t = {q["term"]: q["estimate"] for q in M.tobit_regression(cens, "y", ["x"], left=0.0).collect()}
    yy = np.maximum(y, 0)

    def tl(p):
        s = math.exp(p[2])
        xb = p[0] + p[1] * x
        cdf = np.array([1 - dist.norm_sf(v) for v in (0 - xb) / s])
        return np.sum(np.where(yy <= 0, np.log(np.maximum(cdf, 1e-300)), -0.5 * ((yy - xb) / s) ** 2 - p[2]))

    p = [t["const"], t["x"], t["log_sigma"]]
    assert all(tl(p) >= tl([p[0] + a, p[1] + b_, p[2] + c_]) - 1e-7 for a in (-0.01, 0, 0.01) for b_ in (-0.01, 0, 0.01) for c_ in (-0.01, 0, 0.01))
    f = {q["term"]: q["estimate"] for q in M.firth_logistic(df, "b", ["x"]).collect()}
    assert abs(f["x"]) < abs({q["term"]: q["estimate"] for q in M.logistic_glm(df, "b", ["x"]).collect()}["x"])


def test_survival_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(1, 12)), rng.randrange(2), rng.choice("ab"), rng.random()) for _ in range(80)]
    df = spark.createDataFrame(rows, "t double, e int, g string, x double")
    o = v = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        risk = [r for r in rows if r[0] >= t]
        d = sum(r[0] == t and r[1] for r in risk)
        n, na = len(risk), sum(r[2] == "a" for r in risk)
        o += sum(r[0] == t and r[1] and r[2] == "a" for r in risk) - d * na / n
        v += d * na / n * (1 - na / n) * (n - d) / (n - 1) if n > 1 else 0
    assert L.logrank(df, "t", "e", "g").first()["statistic"] == pytest.approx(o * o / v)

    def efron(b):
        total = 0.0
        for t in {r[0] for r in rows if r[1]}:
            dead = [r for r in rows if r[0] == t and r[1]]
            s0, sd = sum(math.exp(b * r[3]) for r in rows if r[0] >= t), sum(math.exp(b * r[3]) for r in dead)
            total += sum(b * r[3] for r in dead) - sum(math.log(s0 - i / len(dead) * sd) for i in range(len(dead)))
        return total

    b = L.cox_ph(df, "t", "e", ["x"]).first()["estimate"]
    assert efron(b) >= max(efron(b - 1e-3), efron(b + 1e-3))

    info, lines, km = 0.0, [], 1.0
    for t in sorted({r[0] for r in rows if r[1]}):
        risk, dead = [r for r in rows if r[0] >= t], [r for r in rows if r[0] == t and r[1]]
        at = lambda p, part, f: sum(math.exp(b * r[3]) * r[3] ** p for r in risk) - f * sum(math.exp(b * r[3]) * r[3] ** p for r in part)
        fs = [i / len(dead) for i in range(len(dead))]
        means = [at(1, dead, f) / at(0, dead, f) for f in fs]
        info += sum(at(2, dead, f) / at(0, dead, f) - m * m for f, m in zip(fs, means))
        lines.append((1 - km, len(dead), sum(r[3] for r in dead) - sum(means)))
        km *= 1 - len(dead) / len(risk)
    n = sum(m for _, m, _ in lines)
    mean = sum(g * m for g, m, _ in lines) / n
    u, v = sum((g - mean) * r for g, _, r in lines), sum(m * (g - mean) ** 2 for g, m, _ in lines)
    got = {r["term"]: r for r in L.cox_ph_test(df, "t", "e", ["x"]).collect()}
    assert got["x"]["statistic"] == pytest.approx(u * u * n / (info * v), rel=1e-5) and got["GLOBAL"]["statistic"] == pytest.approx(got["x"]["statistic"])


def test_clusters(spark):
    df, x, g, y, *_ = _data(spark)
    gee = {r["term"]: r for r in L.gee(df, "y", ["x"], "k").collect()}
    mix = {r["term"]: r for r in L.mixed_effects(df, "y", ["x"], "k").collect()}
    assert gee["x"]["estimate"] == pytest.approx(2, abs=0.3) and mix["x"]["estimate"] == pytest.approx(2, abs=0.3)


def test_permutations_and_bayes(spark):
    df, *_ = _data(spark)
    two = df.where("g IN ('a', 'b')")
    named = two.withColumn("id", F.concat_ws("|", "x", "y"))
    a, b = (L.randomization_inference(named.repartition(n), "y", "g", draws=200, key="id").first() for n in (3, 7))
    assert 0 < a["p_value"] <= 1 and a["p_value"] == b["p_value"] and 0 < L.randomization_inference(two, "y", "g", draws=50).first()["p_value"] <= 1
    assert 0 <= L.posterior_predictive(df, "y", draws=50).first()["p_value"] <= 1
    assert L.conjugate_bayes(df, "y").first()["posterior_sd"] > 0


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, None, 0.0), (2, "b", 2.0)], "i int, s string, d double")
    r = {x["name"]: x for x in profile(df).collect()}
    assert (r["i"]["unique"], r["s"]["missing"], r["d"]["missing"], r["d"]["zero_fraction"]) == (2, 1, 1, 0.5)
    assert r["s"]["levels"] == ["a", "b"]
    assert profile(df.where("false")).count() == 3


def test_singleton_group_gives_no_test(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b")], "y double, g string")
    assert C.two_group_t(df, "y", "g").count() == 0


def test_randomization_query_uses_the_default_draws(monkeypatch):
    from lodestat.queries import stats as Q

    given = {}
    monkeypatch.setattr(Q, "_valid", lambda s, d: None)
    monkeypatch.setattr(Q, "rounded", lambda df: df)
    monkeypatch.setattr(Q.L, "randomization_inference", lambda *a, **more: given.update(more))
    Q.randomization_inference(None, "")
    assert given.get("draws", 2000) == 2000
