"""Comparing two or more groups, tables of counts, rank tests and correlation.

The data are reduced by one aggregation (groups, cells or distinct values); the rest is arithmetic on
its rows. Rank tests rank the distinct values, so heavy ties make them small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import dist
from lodestat.operators.ordering import running_total, value_slices
from lodestat.operators.preprocess import AnalysisError, complete_cases, number, two_levels


def two_group_t(df: DataFrame, outcome: str, group: str, equal_variances: bool = False, alpha: float = 0.05, need: int = 2) -> DataFrame:
    """Pooled or Welch t test. Levels are ordered by value; the difference is second minus first and
    the statistic first minus second, so their signs differ. One row."""
    d = complete_cases(df, [outcome, group])
    a, b = two_levels(d, group)
    y = number(outcome)
    g = lambda lv: F.when(F.col(group) == lv, y)
    s = d.agg(*[f(g(lv)).alias(f"{n}{i}") for i, lv in ((1, a), (2, b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    row = s.select("*", F.lit(str(a)).alias("first_level"), F.lit(str(b)).alias("second_level"))
    v1, v2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    if equal_variances:
        pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
        se, df_ = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), (F.col("n1") + F.col("n2") - 2).cast("double")
    else:
        se, df_ = F.sqrt(v1 + v2), (v1 + v2) ** 2 / (v1**2 / (F.col("n1") - 1) + v2**2 / (F.col("n2") - 1))
    row = row.where((F.col("n1") >= need) & (F.col("n2") >= need)).withColumn("std_error", se).withColumn("df", df_).withColumn("mean_difference", F.col("mean2") - F.col("mean1"))
    row = row.withColumn("statistic", -F.col("mean_difference") / F.col("std_error"))
    half = dist.t_q(F.lit(1 - alpha / 2), F.col("df")) * F.col("std_error")
    return row.select("first_level", "second_level", "n1", "n2", "mean1", "mean2", "mean_difference", "std_error", "df", "statistic", dist.t_p(F.col("statistic"), F.col("df")).alias("p_value"), (F.col("mean_difference") - half).alias("ci_low"), (F.col("mean_difference") + half).alias("ci_high"))


def paired_t(df: DataFrame, before: str, after: str, alpha: float = 0.05) -> DataFrame:
    d = complete_cases(df, [before, after]).select((number(after) - number(before)).alias("d"))
    s = d.agg(F.count("d").alias("n_pairs"), F.avg("d").alias("mean_difference"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("std_error"))
    s = s.withColumn("df", (F.col("n_pairs") - 1).cast("double")).withColumn("statistic", F.col("mean_difference") / F.col("std_error"))
    half = dist.t_q(F.lit(1 - alpha / 2), F.col("df")) * F.col("std_error")
    return s.select("n_pairs", "mean_difference", "std_error", "df", "statistic", dist.t_p(F.col("statistic"), F.col("df")).alias("p_value"), (F.col("mean_difference") - half).alias("ci_low"), (F.col("mean_difference") + half).alias("ci_high"))


def mid_ranks(df: DataFrame, value: str, into: str = "mid_rank") -> DataFrame:
    """(value, n, mid_rank) per distinct value: ties share the mean of their ranks. The running count
    goes over slices of the distinct values between their quantiles, so no task sorts all of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    sliced, at = value_slices(counts.withColumn("__one", F.lit(1)), value)
    ranked = running_total(sliced, ["__one"], value, F.col("n"), "upto", slice_of=at)
    return ranked.select(value, "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias(into))


def _ranked_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    d = complete_cases(df, [value, group]).select(number(value).alias("v"), F.col(group).alias("g"))
    cells = d.groupBy("v", "g").agg(F.count(F.lit(1)).alias("c"))
    r = mid_ranks(d, "v").withColumnRenamed("n", "ties")
    return cells.join(r, "v")


#: Largest smaller group for which the exact law of U is used, and largest larger group.
EXACT_SMALL, EXACT_LARGE = 8, 20_000


def exact_u_tail(u: float, m: int, n: int) -> float:
    """Two-sided exact probability of U without ties: twice the tail beyond the larger of U and m * n - U. The
    numbers of arrangements are the coefficients of the Gaussian binomial, in whole numbers."""
    size = m * n + 1
    ways = [0] * size
    ways[0] = 1
    for i in range(1, m + 1):
        for k in range(size - 1, n + i - 1, -1):  # times 1 - q ** (n + i)
            ways[k] -= ways[k - n - i]
        for k in range(i, size):  # over 1 - q ** i
            ways[k] += ways[k - i]
    big = math.ceil(max(u, m * n - u))
    return min(1.0, 2 * sum(ways[big:]) / math.comb(m + n, m))


def mann_whitney(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """U of the first level. Exact if the smaller group has at most eight rows and nothing is tied, else the
    normal approximation with tie and continuity correction (also beyond EXACT_LARGE rows in the larger one,
    where the two agree)."""
    d = complete_cases(df, [outcome, group])
    a, b = two_levels(d, group)
    c = _ranked_groups(d, outcome, group)
    is_a = F.col("g") == a
    t = F.col("ties")
    r = c.agg(F.sum(F.when(is_a, F.col("c")).otherwise(0)).alias("n1"), F.sum(F.when(is_a, 0).otherwise(F.col("c"))).alias("n2"), F.sum(F.when(is_a, F.col("c") * F.col("mid_rank")).otherwise(0.0)).alias("r1"), F.sum(F.col("c") * (t.cast("double") * t - 1)).alias("tie_term")).first()
    n1, n2, n = r["n1"], r["n2"], r["n1"] + r["n2"]
    u = r["r1"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - r["tie_term"] / (n * (n - 1))))
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0.0) / sd if sd > 0 else None
    exact = min(n1, n2) <= EXACT_SMALL and max(n1, n2) <= EXACT_LARGE and r["tie_term"] == 0
    p = exact_u_tail(u, min(n1, n2), max(n1, n2)) if exact else None if z is None else min(1.0, 2 * dist.norm_sf(z))
    row = (str(a), str(b), n1, n2, u, z, p, exact)
    return df.sparkSession.createDataFrame([row], "first_level string, second_level string, n1 bigint, n2 bigint, statistic double, z double, p_value double, exact boolean")


def wilcoxon_signed_rank(df: DataFrame, before: str, after: str) -> DataFrame:
    """Zero differences are dropped; normal approximation with continuity and tie correction."""
    d = complete_cases(df, [before, after]).select((number(after) - number(before)).alias("d")).where("d != 0")
    c = d.select(F.abs("d").alias("v"), (F.col("d") > 0).alias("pos"))
    cells = c.groupBy("v", "pos").agg(F.count(F.lit(1)).alias("c")).join(mid_ranks(c, "v").withColumnRenamed("n", "ties"), "v")
    t = F.col("ties").cast("double")
    s = cells.agg(F.sum("c").alias("n_pairs"), F.sum(F.when(F.col("pos"), F.col("c") * F.col("mid_rank")).otherwise(0.0)).alias("statistic"), F.sum(F.col("c") * (t * t - 1)).alias("tie"))
    n = F.col("n_pairs").cast("double")
    dev = F.col("statistic") - n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    s = s.withColumn("z", (dev - 0.5 * F.signum(dev)) / sd)
    return s.select("n_pairs", "statistic", "z", dist.z_p(F.col("z")).alias("p_value"))


def kruskal_wallis(df: DataFrame, outcome: str, group: str) -> DataFrame:
    c = _ranked_groups(df, outcome, group)
    per = c.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("mid_rank")).alias("r"), F.sum(F.col("c") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie"))
    s = per.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("tie").alias("tie"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    s = s.where("n_groups >= 2").withColumn("statistic", h).withColumn("df", F.col("n_groups") - 1)
    return s.select("n_groups", "n", "statistic", "df", dist.chi2_p(F.col("statistic"), F.col("df")).alias("p_value"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of mid-ranks, t approximation."""
    d = complete_cases(df, [x, y]).select(number(x).alias("a"), number(y).alias("b"))
    pairs = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    ra, rb = mid_ranks(d, "a", "ra").select("a", "ra"), mid_ranks(d, "b", "rb").select("b", "rb")
    j = pairs.join(ra, "a").join(rb, "b")
    w = lambda e: F.sum(F.col("c") * e)
    s = j.agg(F.sum("c").alias("n"), w(F.col("ra")).alias("sa"), w(F.col("rb")).alias("sb"), w(F.col("ra") * F.col("ra")).alias("saa"), w(F.col("rb") * F.col("rb")).alias("sbb"), w(F.col("ra") * F.col("rb")).alias("sab"))
    n = F.col("n").cast("double")
    rho = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt((F.col("saa") - F.col("sa") ** 2 / n) * (F.col("sbb") - F.col("sb") ** 2 / n))
    s = s.withColumn("rho", rho).withColumn("t", F.col("rho") * F.sqrt((n - 2) / (1 - F.col("rho") ** 2)))
    return s.select("n", "rho", dist.t_p(F.col("t"), n - 2).alias("p_value"))


def contingency(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """(group, outcome, n) over all pairs of levels, zeros included. Levels, not rows, are crossed."""
    d = complete_cases(df, [group, outcome])
    n = d.groupBy(group, outcome).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(group).distinct().crossJoin(n.select(outcome).distinct())
    return grid.join(n, [group, outcome], "left").select(group, outcome, F.coalesce("n", F.lit(0)).alias("n"))


def chi_square(df: DataFrame, group: str, outcome: str, yates: bool = False) -> DataFrame:
    """Pearson's test of a table of any shape; with yates (two by two only) |O-E| shrinks by at most .5."""
    c = contingency(df, group, outcome)
    all_ = Window.partitionBy(F.lit(1))
    e = F.sum("n").over(Window.partitionBy(group)) * F.sum("n").over(Window.partitionBy(outcome)) / F.sum("n").over(all_)
    c = c.withColumn("e", e)
    gap = F.abs(F.col("n") - F.col("e"))
    gap = gap - F.least(F.lit(0.5), gap) if yates else gap
    s = c.agg(F.sum(gap * gap / F.col("e")).alias("statistic"), F.countDistinct(group).alias("r"), F.countDistinct(outcome).alias("k"), F.sum("n").alias("n"), F.min("e").alias("min_expected"))
    if yates:
        s = s.where("r = 2 AND k = 2")
    s = s.where("r >= 2 AND k >= 2").withColumn("df", (F.col("r") - 1) * (F.col("k") - 1))
    return s.select("n", "statistic", "df", "min_expected", dist.chi2_p(F.col("statistic"), F.col("df")).alias("p_value"))


def fisher_exact(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Two by two, two-sided: the probabilities not above that of the table. Sample odds ratio. The law is summed
    from the mode outwards until its terms no longer matter, some tens of standard deviations."""
    d = complete_cases(df, [group, outcome])
    (g1, _), (o1, _) = two_levels(d, group), two_levels(d, outcome)
    at = lambda same_g, same_o: F.sum(((F.col(group) == g1) == F.lit(same_g)).cast("int") * ((F.col(outcome) == o1) == F.lit(same_o)).cast("int"))
    r = d.agg(at(True, True).alias("a"), at(True, False).alias("b"), at(False, True).alias("c"), at(False, False).alias("d")).first()
    a, b, c, e = r["a"], r["b"], r["c"], r["d"]
    odds = a * e / (b * c) if b * c else (math.inf if a * e else math.nan)
    return df.sparkSession.createDataFrame([(a, b, c, e, None if math.isinf(odds) or math.isnan(odds) else odds, fisher_p(a, b, c, e))], "a bigint, b bigint, c bigint, d bigint, odds_ratio double, p_value double")


def fisher_p(a: int, b: int, c: int, e: int, matters: float = 1e-18) -> float:
    """Ratios of neighbouring terms are exact, so nothing but the terms relative to the mode is needed."""
    row, col, n = a + b, a + c, a + b + c + e
    lo, hi = max(0, col - (n - row)), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), lo), hi)
    up = lambda k: (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))
    terms = {mode: 1.0}
    for step, end in ((1, hi), (-1, lo)):
        v, k = 1.0, mode
        while k != end and (v > matters or (k - a) * step < 0):
            v = v * up(k) if step > 0 else v / up(k - 1)
            k += step
            terms[k] = v
            if v == 0.0:
                break
    own = terms.get(a, 0.0) * (1 + 1e-7)
    return min(1.0, math.fsum(v for v in terms.values() if v <= own) / math.fsum(terms.values()))


def binomial_test(df: DataFrame, outcome: str, null: float = 0.5, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    """Exact; success is the second of two levels in sorted order. Clopper-Pearson interval."""
    if alternative not in ("two-sided", "less", "greater") or not 0 < null < 1:
        raise AnalysisError("unsupported alternative or null probability")
    d = complete_cases(df, [outcome])
    got = two_levels(d, outcome)
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(outcome) == got[1], 1)).alias("k")).first()
    n, k = r["n"], r["k"]
    at_most = lambda j: 1.0 if j >= n else 0.0 if j < 0 else 1.0 - dist.beta_cdf(null, j + 1, n - j)
    less, greater = at_most(k), 1.0 - at_most(k - 1)
    lp = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(null) + (n - j) * math.log1p(-null)
    if alternative == "less":
        p = less
    elif alternative == "greater":
        p = greater
    else:  # the other tail begins where the probability is no larger; found by bisection as it falls off the mode
        own = lp(k) + 1e-7
        mode = math.floor((n + 1) * null)
        if k == n * null:
            p = 1.0
        elif k < n * null:
            lo, hi = min(max(mode, k), n), n + 1
            while lo < hi:
                m = (lo + hi) // 2
                lo, hi = (lo, m) if m > n or lp(m) <= own else (m + 1, hi)
            p = less + (1.0 - at_most(lo - 1))
        else:
            lo, hi = -1, min(mode, k)
            while lo < hi:
                m = (lo + hi + 1) // 2
                lo, hi = (m, hi) if m < 0 or lp(m) <= own else (lo, m - 1)
            p = greater + at_most(lo)
    low = 0.0 if k == 0 else dist.beta_ppf(alpha / 2, k, n - k + 1)
    high = 1.0 if k == n else dist.beta_ppf(1 - alpha / 2, k + 1, n - k)
    return df.sparkSession.createDataFrame([(n, k, k / n, min(1.0, p), low, high)], "n bigint, successes bigint, estimate double, p_value double, ci_low double, ci_high double")


def brier_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Brier score and area under the curve of scores for a 0/1 label."""
    d = complete_cases(df, [score, label]).select(number(score).alias("v"), number(label).alias("g"))
    c = d.groupBy("v", "g").agg(F.count(F.lit(1)).alias("c")).join(mid_ranks(d, "v").select("v", "mid_rank"), "v")
    s = c.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("g")).alias("n1"), F.sum(F.col("c") * (F.col("v") - F.col("g")) ** 2).alias("sq"), F.sum(F.when(F.col("g") == 1, F.col("c") * F.col("mid_rank")).otherwise(0.0)).alias("r"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return s.select("n", (F.col("sq") / F.col("n")).alias("brier"), ((F.col("r") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Means of score and label in bins between the quantiles of the score."""
    d = complete_cases(df, [score, label]).select(number(score).alias("v"), number(label).alias("g"))
    cuts = d.agg(F.percentile("v", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("q")).first()["q"] or []
    which = F.lit(0)
    for q in cuts:
        which = which + (F.col("v") > q).cast("int")
    return d.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_score"), F.avg("g").alias("observed_rate"))


def group_levels(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Group sizes and means, the summary beside a test."""
    d = complete_cases(df, [group, outcome])
    return d.groupBy(F.col(group).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(number(outcome)).alias("mean"), F.stddev_samp(number(outcome)).alias("sd"))
