"""Survival, clusters, Bayes and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.operators.ordering import group_rank, hash_order, running_total, running_totals, value_slices
from lodestat.operators.preprocess import AnalysisError, complete_cases, levels, number, two_levels
from lodestat.operators.stats.models import _dot, _frame, _inverse, _matrix, _newton, _products, _vector, term_rows


def _risk_sums(per_time: DataFrame, groups: list[str], values: list[str], slice_of: Column | None = None) -> DataFrame:
    """Sums over all rows with the same or a later time, per distinct time; slices between quantiles of the times, or by
    a column made before that falls with the time."""
    back = per_time.withColumn("__neg", -F.col("t"))
    if slice_of is None:
        back, slice_of = value_slices(back, "__neg")
    return running_totals(back, groups, "__neg", {f"r_{v}": F.col(v) for v in values}, slice_of=slice_of).drop("__neg")


def logrank(df: DataFrame, time: str, event: str, group: str, most_groups: int = 1000) -> DataFrame:
    """Chi-square of the log-rank test. The driver inverts a matrix of the groups' number; more than
    `most_groups` are an error."""
    d = complete_cases(df, [time, event, group]).select(number(time).alias("t"), number(event).alias("e"), F.col(group).alias("g"))
    names = levels(d, "g", most_groups)
    k = len(names)
    if k < 2:
        raise AnalysisError("the log-rank test needs two groups")
    counts = {f"n{i}": F.count(F.when(F.col("g") == v, 1)) for i, v in enumerate(names)}
    deaths = {f"d{i}": F.count(F.when((F.col("g") == v) & (F.col("e") == 1), 1)) for i, v in enumerate(names)}
    per = d.groupBy("t").agg(*[c.alias(n) for n, c in (counts | deaths).items()]).withColumn("one", F.lit(1))
    r = _risk_sums(per, ["one"], list(counts))
    plus = lambda p: sum((F.col(f"{p}{i}") for i in range(1, k)), F.col(f"{p}0")).cast("double")
    r = r.withColumns({"dd": plus("d"), "nn": plus("r_n")}).where("dd > 0")
    share = [F.col(f"r_n{i}") / F.col("nn") for i in range(k)]
    scale = F.when(F.col("nn") > 1, F.col("dd") * (F.col("nn") - F.col("dd")) / (F.col("nn") - 1)).otherwise(0.0)
    aggs = [F.sum(F.col(f"d{i}") - F.col("dd") * share[i]).alias(f"b{i}") for i in range(k - 1)]
    aggs += [F.sum(scale * (share[i] * ((1.0 if i == j else 0.0) - share[j]))).alias(f"a{i}_{j}") for i in range(k - 1) for j in range(i, k - 1)]
    s = r.agg(*aggs).first()
    u, v = _vector(s, k - 1), _matrix(s, k - 1)
    stat = float(u @ np.linalg.pinv(v) @ u)
    n = d.count()
    return df.sparkSession.createDataFrame([(n, k, stat, k - 1, dist.chi2_sf(stat, k - 1))], "n bigint, n_groups int, statistic double, df int, p_value double")


class _Cox:
    """Efron's partial likelihood over distinct times. Per pass: sums by time, risk sums over later times; ties enter by
    their number per time."""

    def __init__(self, df: DataFrame, time: str, event: str, predictors: Sequence[str]):
        base = complete_cases(df, [time, event, *predictors])
        d, terms = _frame(base, time, predictors, [event])
        d = d.select(F.expr("slice(x, 2, size(x) - 1)").alias("x"), F.col("y").alias("t"), number(event).alias("e")).withColumn("__neg", -F.col("t"))
        d, _ = value_slices(d, "__neg", into="at")  # once for all rounds
        self.d = d.drop("__neg").cache()
        self.terms, self.k = terms[1:], len(terms) - 1
        self.pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        self.names = ["s0", *[f"s{i}" for i in range(1, self.k + 1)], *[f"q{i}_{j}" for i, j in self.pairs]]

    def times(self, b: np.ndarray) -> DataFrame:
        """A line per time with events: sums x0.. of the events' predictors, their number m, sums over the risk set (r_) and
        over the events (d_), and per tie l the part f taken out of the risk set."""
        k, w = self.k, F.exp(_dot(b))
        own = {"s0": w, **{f"s{i + 1}": w * F.col("x")[i] for i in range(k)}, **{f"q{i}_{j}": w * F.col("x")[i] * F.col("x")[j] for i, j in self.pairs}}
        dead = F.col("e") == 1
        aggs = [F.sum(v).alias(n) for n, v in own.items()] + [F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d_{n}") for n, v in own.items()]
        aggs += [F.sum(F.when(dead, F.col("x")[i]).otherwise(0.0)).alias(f"x{i}") for i in range(k)] + [F.count(F.when(dead, 1)).alias("m"), F.count(F.lit(1)).alias("here")]
        per = self.d.groupBy("t", "at").agg(*aggs).withColumn("one", F.lit(1))
        r = _risk_sums(per, ["one"], [*self.names, "here"], F.col("at")).where("m > 0")
        return r.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("l")).withColumn("f", F.col("l") / F.col("m"))

    def parts(self) -> tuple[list[Column], list[Column]]:
        """Per line of `times`: residuals of the events, and the information."""
        at = lambda n: F.col(f"r_{n}") - F.col("f") * F.col(f"d_{n}")
        score = [F.col(f"x{i}") / F.col("m") - at(f"s{i + 1}") / at("s0") for i in range(self.k)]
        info = [at(f"q{i}_{j}") / at("s0") - at(f"s{i + 1}") * at(f"s{j + 1}") / at("s0") ** 2 for i, j in self.pairs]
        return score, info

    def step(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, info = self.parts()
        sums = [F.sum(c).alias(f"b{i}") for i, c in enumerate(score)] + [F.sum(c).alias(f"a{i}_{j}") for c, (i, j) in zip(info, self.pairs)]
        s = self.times(b).agg(*sums).first()
        return _vector(s, self.k), _matrix(s, self.k)

    def fit(self, rounds: int) -> tuple[np.ndarray, np.ndarray, bool]:
        return _newton(self.d, self.k, self.step, np.zeros(self.k), rounds)


def cox_ph(df: DataFrame, time: str, event: str, predictors: Sequence[str], rounds: int = 30) -> DataFrame:
    """Efron's partial likelihood, with hazard ratios."""
    c = _Cox(df, time, event, predictors)
    b, info, done = c.fit(rounds)
    c.d.unpersist()
    return term_rows(df, c.terms, b, _inverse(info), None).withColumn("hazard_ratio", F.exp("estimate")).withColumn("converged", F.lit(done))


def cox_ph_test(df: DataFrame, time: str, event: str, predictors: Sequence[str], rounds: int = 30) -> DataFrame:
    """Proportional hazards, by term and over all (GLOBAL): Grambsch and Therneau's chi-square of the residuals of events
    against one minus the Kaplan-Meier survival just before them. One line per distinct time stays distributed; the
    survival is a running sum of logarithms over slices."""
    c = _Cox(df, time, event, predictors)
    b, info, _ = c.fit(rounds)
    score, _ = c.parts()
    r = c.times(b).groupBy("t").agg(F.first("m").alias("m"), F.first("r_here").alias("n"), *[F.sum(e).alias(f"u{i}") for i, e in enumerate(score)])
    # the last time may empty the risk set; it is no earlier time of any other
    drop = F.when(F.col("n") > F.col("m"), F.log1p(-F.col("m") / F.col("n"))).otherwise(0.0)
    sliced, at = value_slices(r.withColumn("one", F.lit(1)), "t")
    r = running_totals(sliced, ["one"], "t", {"upto": drop}, slice_of=at)
    g = 1 - F.exp(F.col("upto") - drop)
    cols = [F.sum("m").alias("d"), F.sum(F.col("m") * g).alias("g1"), F.sum(F.col("m") * g * g).alias("g2")]
    cols += [F.sum(f"u{i}").alias(f"s{i}") for i in range(c.k)] + [F.sum(g * F.col(f"u{i}")).alias(f"w{i}") for i in range(c.k)]
    s = r.agg(*cols).first()
    c.d.unpersist()
    if not s["d"]:
        raise AnalysisError("no events")
    mean = s["g1"] / s["d"]
    spread = s["g2"] - s["d"] * mean**2
    u = np.array([s[f"w{i}"] - mean * s[f"s{i}"] for i in range(c.k)])
    inv = _inverse(info)
    rows = [(term, (inv @ u)[i] ** 2 * s["d"] / (inv[i, i] * spread), 1) for i, term in enumerate(c.terms)] + [("GLOBAL", float(u @ inv @ u) * s["d"] / spread, c.k)]
    return df.sparkSession.createDataFrame([(t, float(x), k, dist.chi2_sf(float(x), k)) for t, x, k in rows], "term string, statistic double, df int, p_value double")


def _clusters(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str) -> tuple[DataFrame, list[str]]:
    """Sufficient sums per cluster."""
    d, terms = _frame(df, outcome, predictors, [cluster])
    k = len(terms)
    d = d.withColumn("g", F.col(cluster))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy")]
    sums += [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + _products(k, y=F.col("y"))
    return d.groupBy("g").agg(*sums), terms


def _by_size(c: DataFrame, k: int) -> pd.DataFrame:
    """Sums over the clusters of each size; sizes differ at most sqrt(2 * rows) times."""
    outer = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"o{i}_{j}") for i in range(k) for j in range(i, k)]
    cross = [F.sum(F.col(f"s{i}") * F.col("sy")).alias(f"c{i}") for i in range(k)]
    plain = [F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(f"b{i}").alias(f"b{i}") for i in range(k)]
    return c.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.sum("syy").alias("syy"), F.sum(F.col("sy") ** 2).alias("sy2"), *outer, *cross, *plain).toPandas()


def _weighted(t: pd.DataFrame, k: int, shrink) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wy and y'Wy for W = I - shrink(n) 11' inside clusters."""
    a, b = np.zeros((k, k)), np.zeros(k)
    c = shrink(t["n"].to_numpy(float)) * np.ones(len(t))
    sums = lambda col, w: float(t[col].to_numpy(float) @ w)
    one = np.ones(len(t))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = sums(f"a{i}_{j}", one) - sums(f"o{i}_{j}", c)
        b[i] = sums(f"b{i}", one) - sums(f"c{i}", c)
    return a, b, sums("syy", one) - sums("sy2", c)


def gee(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str, rounds: int = 60) -> DataFrame:
    """Gaussian estimating equations, exchangeable correlation by moments, sandwich errors."""
    c, terms = _clusters(df, outcome, predictors, cluster)
    k = len(terms)
    c = c.cache()
    t = _by_size(c, k)
    n = int((t["n"] * t["m"]).sum())
    pairs = float((t["n"] * (t["n"] - 1) / 2 * t["m"]).sum())
    alpha, b = 0.0, np.zeros(k)
    for _ in range(rounds):
        a, xy, _ = _weighted(t, k, lambda m: alpha / (1 + (m - 1) * alpha))
        new = _inverse(a) @ xy
        plain_a, plain_b, yy = _weighted(t, k, lambda m: 0.0)
        e2 = yy - 2 * new @ plain_b + new @ plain_a @ new
        outer_a, outer_b, outer_yy = _weighted(t, k, lambda m: 1.0)  # the plain sums less those of clusters
        s2 = (yy - outer_yy) - 2 * new @ (plain_b - outer_b) + new @ (plain_a - outer_a) @ new
        phi = e2 / (n - k)
        nxt = (s2 - e2) / 2 / ((pairs - k) * phi) if pairs > k and phi > 0 else 0.0
        done = np.max(np.abs(new - b)) < 1e-10 * max(1.0, np.max(np.abs(new))) and abs(nxt - alpha) < 1e-10
        b, alpha = new, float(nxt)
        if done:
            break
    shrink = F.lit(alpha) / (1 + (F.col("n") - 1) * F.lit(alpha))
    e_sum = F.col("sy") - sum((F.lit(float(b[i])) * F.col(f"s{i}") for i in range(1, k)), F.lit(float(b[0])) * F.col("s0"))
    sym = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}")
    u = []
    for i in range(k):
        xe = F.col(f"b{i}")
        for j in range(k):
            xe = xe - F.lit(float(b[j])) * sym(i, j)
        u.append(xe - shrink * F.col(f"s{i}") * e_sum)
    r = c.select(*[v.alias(f"u{i}") for i, v in enumerate(u)]).agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    c.unpersist()
    bread = _inverse(_weighted(t, k, lambda m: alpha / (1 + (m - 1) * alpha))[0])
    return term_rows(df, terms, b, bread @ _matrix(r, k) @ bread, None).withColumn("correlation", F.lit(alpha))


def mixed_effects(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str) -> DataFrame:
    """Random intercept by restricted likelihood, profiled over the variance ratio; normal inference."""
    c, terms = _clusters(df, outcome, predictors, cluster)
    k = len(terms)
    t = _by_size(c, k)
    n = int((t["n"] * t["m"]).sum())

    def fit(log_ratio: float):
        lam = math.exp(log_ratio)
        a, xy, yy = _weighted(t, k, lambda m: lam / (1 + m * lam))
        b = _inverse(a) @ xy
        rss = max(yy - b @ xy, 1e-300)
        det = float((t["m"] * np.log1p(t["n"] * lam)).sum())
        sign, ld = np.linalg.slogdet(a)
        return (n - k) * math.log(rss / (n - k)) + det + ld, b, a, rss / (n - k), lam

    lo, hi = -20.0, 12.0
    gold = (math.sqrt(5) - 1) / 2
    grid = np.linspace(lo, hi, 65)
    best = int(np.argmin([fit(g)[0] for g in grid]))
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 64)]
    x1, x2 = hi - gold * (hi - lo), lo + gold * (hi - lo)
    f1, f2 = fit(x1)[0], fit(x2)[0]
    while hi - lo > 1e-9:
        if f1 < f2:
            hi, x2, f2 = x2, x1, f1
            x1 = hi - gold * (hi - lo)
            f1 = fit(x1)[0]
        else:
            lo, x1, f1 = x1, x2, f2
            x2 = lo + gold * (hi - lo)
            f2 = fit(x2)[0]
    _, b, a, s2, lam = fit((lo + hi) / 2)
    return term_rows(df, terms, b, s2 * _inverse(a), None).withColumn("residual_variance", F.lit(s2)).withColumn("cluster_variance", F.lit(s2 * lam))


def conjugate_bayes(df: DataFrame, outcome: str, prior_mean: float = 0.0, prior_sd: float = 10.0, alpha: float = 0.05) -> DataFrame:
    """Normal mean with the sample variance plugged in."""
    d = complete_cases(df, [outcome])
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg(number(outcome)).alias("mean"), F.var_samp(number(outcome)).alias("var"))
    prec = F.lit(1 / prior_sd**2) + F.col("n") / F.col("var")
    s = s.withColumn("posterior_mean", (F.lit(prior_mean / prior_sd**2) + F.col("n") * F.col("mean") / F.col("var")) / prec).withColumn("posterior_sd", 1 / F.sqrt(prec))
    q = dist.norm_ppf(1 - alpha / 2)
    return s.select("n", "posterior_mean", "posterior_sd", (F.col("posterior_mean") - q * F.col("posterior_sd")).alias("ci_low"), (F.col("posterior_mean") + q * F.col("posterior_sd")).alias("ci_high"))


_BLOCK = 20_000
#: Rows of a block times draws held at once.
_CHUNK = 8_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int, size: int | None = None) -> np.ndarray:
    """Exact up to 10 ** 9 rows, the bound of the generator; beyond, the normal law with the same mean and
    variance, rounded and kept inside the support (they differ by less than one in 10 ** 4 there)."""
    n = good + bad
    if n < 1_000_000_000:
        return rng.hypergeometric(good, bad, take, size)
    p = good / n
    sd = math.sqrt(take * p * (1 - p) * (n - take) / (n - 1))
    return np.clip(np.rint(rng.normal(take * p, sd, size)), max(0, take - bad), min(take, good)).astype(np.int64)


def _shares(rng: np.random.Generator, sizes: Sequence[int], take: int, draws: int) -> np.ndarray:
    """How many of the `take` chosen rows fall into each block, per draw: halves of the blocks in turn."""
    out = np.zeros((draws, len(sizes)), np.int64)

    def part(lo: int, hi: int, took: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = took
            return
        mid = (lo + hi) // 2
        left, right = int(sum(sizes[lo:mid])), int(sum(sizes[mid:hi]))
        values, at = np.unique(took, return_inverse=True)
        first = np.zeros(len(took), np.int64)
        for i, v in enumerate(values):
            where = at == i
            first[where] = hypergeometric(rng, left, right, int(v), int(where.sum())) if left + right else 0
        part(lo, mid, first)
        part(mid, hi, took - first)

    part(0, len(sizes), np.full(draws, take, np.int64))
    return out


def _block_sizes(d: DataFrame, seed: int, *cols: str) -> tuple[DataFrame, list[int]]:
    """Rows in blocks by hash, about _BLOCK rows each (the driver holds one number per block and draw, so at
    most 4096 blocks; larger blocks are then worked in chunks)."""
    n = d.count()
    blocks = max(1, min(4096, math.ceil(n / _BLOCK)))
    d = d.withColumn("__block", F.pmod(hash_order(seed, *cols), F.lit(blocks)).cast("int"))
    sizes = {r["__block"]: r["n"] for r in d.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}
    return d, [sizes.get(i, 0) for i in range(blocks)]


def posterior_predictive(df: DataFrame, outcome: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Two-sided p of the sample skewness among replicated samples of the same size. Replicates are
    drawn block by block as power sums; nothing of the size of the sample is gathered."""
    y = number(outcome)
    d = complete_cases(df, [outcome]).select(y.alias("y"))
    n, m, sd = d.agg(F.count("y"), F.avg("y"), F.stddev_samp("y")).first()
    if not n or n < 3 or not sd:
        raise AnalysisError("too few or constant observations")
    obs = d.agg((F.avg((F.col("y") - m) ** 3) / F.pow(F.avg((F.col("y") - m) ** 2), 1.5)).alias("s")).first()["s"]
    spark = df.sparkSession
    blocks = max(1, math.ceil(n / _BLOCK))
    at = spark.range(blocks).withColumn("size", F.when(F.col("id") < blocks - 1, _BLOCK).otherwise(n - _BLOCK * (blocks - 1)))

    def run(batches):
        for pdf in batches:
            for b, size in zip(pdf["id"], pdf["size"]):
                out = np.empty((draws, 4))
                for r in range(draws):
                    z = np.random.default_rng((seed, int(b), r)).standard_normal(int(size))
                    out[r] = r, z.sum(), (z * z).sum(), (z * z * z).sum()
                yield pd.DataFrame({"r": out[:, 0].astype("int32"), "s1": out[:, 1], "s2": out[:, 2], "s3": out[:, 3]})

    # the skewness of a normal sample depends on neither its mean nor its scale
    sums = at.repartition(min(blocks, 2000), "id").mapInPandas(run, "r int, s1 double, s2 double, s3 double").groupBy("r").agg(F.sum("s1").alias("a"), F.sum("s2").alias("b"), F.sum("s3").alias("c"))
    a, b, c = (F.col(v) / float(n) for v in "abc")
    skew = (c - 3 * a * b + 2 * a**3) / F.pow(b - a**2, 1.5)
    tail = sums.agg(F.avg((F.abs(skew) >= abs(obs)).cast("double")).alias("p_value"))
    return tail.select(F.lit(n).alias("n"), F.lit(float(obs)).alias("observed_skewness"), F.lit(draws).alias("draws"), "p_value")


#: Fixed value: most permutations.
MOST_DRAWS = 5000


def randomization_inference(df: DataFrame, outcome: str, treatment: str, draws: int = 2000, seed: int = 0, key: str | None = None) -> DataFrame:
    """Labels permuted with their number kept: how many of a block are treated follows the multivariate
    hypergeometric law, which of them a permutation inside the block. p = (1 + hits) / (1 + draws), with at most
    MOST_DRAWS draws. Blocks are by the hash of `key`, so equal seeds give equal results for any partitioning;
    without a key they depend on it, as rows have no name then."""
    draws = min(draws, MOST_DRAWS)
    d = complete_cases(df, [outcome, treatment, *([key] if key else [])])
    a, b = two_levels(d, treatment)
    d = d.select(number(outcome).alias("y"), (F.col(treatment) == b).alias("t"), (F.col(key) if key else F.monotonically_increasing_id()).alias("__id"))
    n, n1, s, s1 = d.agg(F.count(F.lit(1)), F.sum(F.col("t").cast("int")), F.sum("y"), F.sum(F.when(F.col("t"), F.col("y")).otherwise(0.0))).first()
    obs = s1 / n1 - (s - s1) / (n - n1)
    blocked, sizes = _block_sizes(d, seed, "__id")
    take = _shares(np.random.default_rng(seed), sizes, n1, draws)

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.sort(pdf["y"].to_numpy())
        rng = np.random.default_rng((seed, int(key_[0])))
        sums = [y[rng.choice(len(y), take[r, key_[0]], replace=False, shuffle=False)].sum() for r in range(draws)]
        return pd.DataFrame({"r": np.arange(draws, dtype="int32"), "s": sums})

    sums = blocked.select("y", "__block").groupBy("__block").applyInPandas(run, "r int, s double").groupBy("r").agg(F.sum("s").alias("s"))
    null = F.col("s") / n1 - (F.lit(s) - F.col("s")) / (n - n1)
    hits = sums.agg(F.count(F.when(F.abs(null) >= abs(obs) - 1e-12, 1)).alias("h"))
    return hits.select(F.lit(n).alias("n"), F.lit(float(obs)).alias("effect"), F.lit(draws).alias("draws"), ((F.col("h") + 1) / F.lit(draws + 1.0)).alias("p_value"))


def multiple_imputation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What an imputation would face: complete cases and missing cells. Nothing is imputed."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    missing = sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(complete, 1)).alias("complete_cases"), F.sum(missing).alias("missing_cells")).withColumn("n_columns", F.lit(len(columns)))


def blocked_time_series_cv(df: DataFrame, time: str, outcome: str, predictors: Sequence[str], splits: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Rows in time order; split i trains on all blocks before its test block. Per split rmse and mae.
    Row numbers come from running counts over time slices; equal times are ordered by `tie`."""
    d, terms = _frame(complete_cases(df, [time, outcome, *predictors, *tie]), outcome, predictors, [time, *tie])
    k = len(terms)
    stamp = F.col(time).cast("timestamp").cast("double") if dict(df.dtypes)[time].startswith("timestamp") else number(time)
    d = d.withColumn("__t", stamp)
    n = d.count()
    d, at = value_slices(d.withColumn("__one", F.lit(1)), "__t", 1024)
    d = running_total(d, ["__one"], "__t", F.lit(1).cast("long"), "rn", tie=tie, slice_of=at)
    size = n // (splits + 1)
    if size < 1:
        raise AnalysisError("too few observations for the splits")
    # the first block takes the remainder, as all test blocks are equally long
    first = n - splits * size
    d = d.withColumn("fold", F.when(F.col("rn") <= first, 0).otherwise(F.floor((F.col("rn") - 1 - first) / size).cast("int") + 1)).cache()
    rows = {r["fold"]: r for r in d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *_products(k, y=F.col("y"))).collect()}
    a, v = np.zeros((k, k)), np.zeros(k)
    when = None
    for f in range(splits + 1):
        if f:
            fitted = _dot(_inverse(a) @ v)
            when = F.when(F.col("fold") == f, fitted) if when is None else when.when(F.col("fold") == f, fitted)
        a, v = a + _matrix(rows[f], k), v + _vector(rows[f], k)
    e = F.col("y") - when
    return d.where("fold > 0").groupBy(F.col("fold").alias("split")).agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e**2)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def held_out_scores(df: DataFrame, outcome: str, predictors: Sequence[str], key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(y, score): scores from ridge fits on the other folds. Folds are stratified: inside each class rows are
    dealt out in turn, in hash order of the key."""
    from lodestat.operators.stats.models import glm

    d = complete_cases(df, [outcome, key, *predictors]).withColumn("__h", hash_order(seed, F.col(key)))
    d = group_rank(d, [outcome], "__h", "__turn", tie=[key])
    d = d.withColumn("__fold", F.pmod(F.col("__turn") - 1, F.lit(folds)).cast("int")).drop("__h", "__turn").cache()
    x, _ = _frame(d, outcome, predictors, ["__fold"])
    score = None
    for f in range(folds):
        _, c, b, _, _, _ = glm(d.where(F.col("__fold") != f), outcome, predictors, "binomial", ridge=1.0)
        c.unpersist()
        s = 1 / (1 + F.exp(-_dot(b)))
        score = F.when(F.col("__fold") == f, s) if score is None else score.when(F.col("__fold") == f, s)
    return x.withColumn("score", score).select("y", "score", F.col("__fold").alias("fold"))


def calibrated_logistic(df: DataFrame, outcome: str, predictors: Sequence[str], key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Brier score and AUC of held-out scores."""
    from lodestat.operators.stats.compare import brier_auc

    return brier_auc(held_out_scores(df, outcome, predictors, key, folds, seed), "score", "y")


def calibration_curve(df: DataFrame, outcome: str, predictors: Sequence[str], key: str, folds: int = 5, seed: int = 0, bins: int = 10) -> DataFrame:
    """Mean score and observed rate of held-out scores between their quantiles."""
    from lodestat.operators.stats.compare import calibration_bins

    return calibration_bins(held_out_scores(df, outcome, predictors, key, folds, seed), "score", "y", bins)


__all__ = ["blocked_time_series_cv", "calibrated_logistic", "calibration_curve", "conjugate_bayes", "cox_ph", "cox_ph_test", "gee", "held_out_scores", "logrank", "mixed_effects", "multiple_imputation", "posterior_predictive", "randomization_inference"]
