"""Statistical procedures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators import preprocess as P
from lodestat.operators import profile as PR
from lodestat.operators.stats import compare as C
from lodestat.operators.stats import longitudinal as L
from lodestat.operators.stats import models as M
from lodestat.sources.tables import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def _items(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(s, d, "lineitem").select(*cols)


def _two_flags(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return P.row_filters(_items(s, d, "l_returnflag", *cols), [{"column": "l_returnflag", "operation": "include", "values": ["A", "R"]}])


def _order_pairs(s: SparkSession, d: str) -> DataFrame:
    """First and last line price of each order."""
    e = F.struct("l_linenumber", "l_extendedprice")
    i = _items(s, d, "l_orderkey", "l_linenumber", "l_extendedprice").groupBy("l_orderkey").agg(F.min(e).alias("a"), F.max(e).alias("b"), F.count(F.lit(1)).alias("n"))
    return i.where("n > 1").select(F.col("a.l_extendedprice").alias("first_price"), F.col("b.l_extendedprice").alias("last_price"))


def _valid(s: SparkSession, d: str) -> DataFrame:
    """Predictions as 0/1 with regret: the binary outcomes of the tables."""
    p = table(s, d, "predictions").select("prediction_id", F.col("valid").cast("int").alias("valid"), "normalized_regret", "domain")
    return p.withColumn("hit", (F.col("normalized_regret") < 0.2).cast("int"))


def _user_counts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def _survival(s: SparkSession, d: str) -> DataFrame:
    """Per user: hours from the first event to the first purchase, censored at the last event."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value", "event_id")
    u = e.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(F.when(F.col("event_type") == "purchase", F.col("t"))).alias("tp"), F.min_by("event_type", F.struct("t", "event_id")).alias("first_type"), F.min_by("value", F.struct("t", "event_id")).alias("first_value"))
    return u.select("user_id", "first_type", "first_value", F.round((F.coalesce("tp", "t1") - F.col("t0")) / 3.6e9, 3).alias("hours"), F.col("tp").isNotNull().cast("int").alias("event"))


def welch_t(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.two_group_t(_two_flags(s, d, "l_extendedprice"), "l_extendedprice", "l_returnflag"))


def independent_t(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.two_group_t(_two_flags(s, d, "l_extendedprice"), "l_extendedprice", "l_returnflag", equal_variances=True))


def difference_in_means(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.two_group_t(_valid(s, d), "normalized_regret", "valid"))


def paired_t(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.paired_t(_order_pairs(s, d), "first_price", "last_price"))


def wilcoxon_signed_rank(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.wilcoxon_signed_rank(_order_pairs(s, d), "first_price", "last_price"))


def mann_whitney(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.mann_whitney(_two_flags(s, d, "l_quantity"), "l_quantity", "l_returnflag"))


def kruskal_wallis(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.kruskal_wallis(table(s, d, "orders").select("o_totalprice", "o_orderpriority"), "o_totalprice", "o_orderpriority"))


def spearman_correlation(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.spearman(table(s, d, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice"))


def chi_square(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.chi_square(_items(s, d, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus"))


def two_proportion(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.chi_square(_two_flags(s, d, "l_linestatus"), "l_returnflag", "l_linestatus", yates=True))


def fisher_exact(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.fisher_exact(_two_flags(s, d, "l_linestatus"), "l_returnflag", "l_linestatus"))


def binomial_test(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.binomial_test(_valid(s, d), "valid"))


def contingency_table(s: SparkSession, d: str) -> DataFrame:
    return C.contingency(_items(s, d, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


def mid_ranks(s: SparkSession, d: str) -> DataFrame:
    return C.mid_ranks(_items(s, d, "l_quantity"), "l_quantity")


def profile_columns(s: SparkSession, d: str) -> DataFrame:
    return rounded(PR.profile(table(s, d, "customer")).select("name", "missing", "unique", "minimum", "maximum", "zero_fraction"))


def profile_predictions(s: SparkSession, d: str) -> DataFrame:
    return rounded(PR.profile(table(s, d, "predictions").select("adapter_id", "language", "normalized_regret", "valid")).select("name", "missing", "unique", F.array_join("levels", "|").alias("levels"), "minimum", "maximum"))


def duplicate_rows(s: SparkSession, d: str) -> DataFrame:
    return PR.duplicate_rows(table(s, d, "predictions").select("blueprint_id", "adapter_id", "language", "predicted_method_id", "normalized_regret"))


def row_filter_recode(s: SparkSession, d: str) -> DataFrame:
    x = P.row_filters(table(s, d, "predictions").select("language", "domain", "valid", "predicted_method_id"), [{"column": "language", "operation": "exclude", "values": ["en"]}, {"column": "domain", "operation": "include", "values": ["inference_and_design", "probability_and_bayes"]}])
    x = P.recode_binary(x, [{"column": "predicted_method_id", "positive_values": ["ols", "welch_t"]}])
    return x.groupBy("language", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted_method_id").alias("positives"))


def ols(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.ols(_items(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice", ["l_quantity"]), 4)


def hc3_ols(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.ols(_items(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice", ["l_quantity"], "hc3"), 4)


def ancova(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.ols(_items(s, d, "l_extendedprice", "l_quantity", "l_discount", "l_returnflag"), "l_extendedprice", ["l_returnflag", "l_quantity", "l_discount"], "hc3"), 4)


def regression_f_test(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.regression_f_test(_items(s, d, "l_extendedprice", "l_quantity"), "l_extendedprice", ["l_quantity"]), 4)


def iv_2sls(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.iv_2sls(_items(s, d, "l_extendedprice", "l_quantity", "l_tax").withColumn("z", F.col("l_quantity") + 40 * F.col("l_tax")), "l_extendedprice", "l_quantity", ["z"]).select("term", "estimate"), 4)


def huber_regression(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.huber(_items(s, d, "l_extendedprice", "l_quantity", "l_discount"), "l_extendedprice", ["l_quantity", "l_discount"]), 4)


def _binary(s: SparkSession, d: str) -> DataFrame:
    return _valid(s, d).select("valid", F.col("normalized_regret").alias("regret"), "domain")


def logistic_glm(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.logistic_glm(_binary(s, d), "valid", ["regret", "domain"]), 5)


def logistic_regret(s: SparkSession, d: str) -> DataFrame:
    """One predictor: SQL can follow the Newton steps."""
    return rounded(M.logistic_glm(_binary(s, d), "valid", ["regret"]).select("term", "estimate", "std_error", "statistic", "p_value"), 5)


def poisson_regret(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.poisson_glm(_user_counts(s, d), "n", ["mean_value"]).select("term", "estimate", "std_error", "statistic", "p_value"), 5)


def logrank_two(s: SparkSession, d: str) -> DataFrame:
    """Users who came by a click against all others."""
    x = _survival(s, d).withColumn("by_click", F.coalesce(F.col("first_type") == "click", F.lit(False)).cast("string"))
    return rounded(L.logrank(x, "hours", "event", "by_click"))


def ancova_flag(s: SparkSession, d: str) -> DataFrame:
    """Adjusted difference of two groups with one covariate."""
    x = _two_flags(s, d, "l_extendedprice", "l_quantity").withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(M.ols(x, "l_extendedprice", ["g", "l_quantity"], "hc3").select("term", "estimate", "std_error"), 3)


def probit_glm(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.probit_glm(_binary(s, d), "valid", ["regret", "domain"]), 5)


def firth_logistic(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.firth_logistic(_binary(s, d), "valid", ["regret", "domain"]), 5)


def poisson_glm(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.poisson_glm(_user_counts(s, d), "n", ["event_type"]), 5)


def negative_binomial_glm(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.negative_binomial_glm(_user_counts(s, d).withColumn("n", F.col("n") + F.pmod(F.xxhash64("user_id", "event_type"), F.lit(7)) * 3), "n", ["event_type"]), 4)


def tobit_regression(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.greatest(F.col("value"), F.lit(100.0)).alias("value"), "event_type")
    return rounded(M.tobit_regression(e, "value", ["event_type"], left=100.0), 4)


def gee(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.gee(table(s, d, "events").select("value", "event_type", "user_id"), "value", ["event_type"], "user_id"), 5)


def mixed_effects(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.mixed_effects(table(s, d, "customer").select("c_acctbal", "c_mktsegment", "c_nationkey"), "c_acctbal", ["c_mktsegment"], "c_nationkey"), 3)


def logrank(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.logrank(_survival(s, d), "hours", "event", "first_type"))


def cox_ph(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.cox_ph(_survival(s, d), "hours", "event", ["first_value"]), 6)


def cox_ph_test(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.cox_ph_test(_survival(s, d), "hours", "event", ["first_value"]), 5)


def conjugate_bayes(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.conjugate_bayes(table(s, d, "customer").select("c_acctbal"), "c_acctbal"))


def posterior_predictive(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.posterior_predictive(table(s, d, "customer").select("c_acctbal"), "c_acctbal"))


def randomization_inference(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.randomization_inference(_valid(s, d), "normalized_regret", "valid", key="prediction_id"))


def ipw(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.ipw(_valid(s, d).withColumn("treated", (F.col("domain") == "inference_and_design").cast("int")), "hit", "treated", ["normalized_regret"]), 5)


def multiple_imputation(s: SparkSession, d: str) -> DataFrame:
    return L.multiple_imputation(table(s, d, "predictions"), ["language", "normalized_regret", "valid"])


def calibrated_logistic(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.calibrated_logistic(_valid(s, d), "valid", ["normalized_regret"], "prediction_id"), 5)


def calibration_curve(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.calibration_curve(_valid(s, d), "valid", ["normalized_regret"], "prediction_id"), 5)


def stratified_folds(s: SparkSession, d: str) -> DataFrame:
    """Rows and positives per fold of the calibration: both differ by at most one between folds."""
    x = L.held_out_scores(_valid(s, d), "valid", ["normalized_regret"], "prediction_id")
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("n_valid"))


def brier_auc(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.brier_auc(_valid(s, d).withColumn("score", 1 - F.col("normalized_regret")), "score", "valid"))


def calibration_bins(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.calibration_bins(_valid(s, d).withColumn("score", 1 - F.col("normalized_regret")), "score", "valid"))


def blocked_time_series_cv(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.blocked_time_series_cv(table(s, d, "orders").select("o_orderdate", "o_totalprice", "o_custkey", "o_orderkey"), "o_orderdate", "o_totalprice", ["o_custkey"], tie=["o_orderkey"]), 4)


_ALL = [welch_t, independent_t, difference_in_means, paired_t, wilcoxon_signed_rank, mann_whitney, kruskal_wallis, spearman_correlation, chi_square, two_proportion, fisher_exact, binomial_test, contingency_table, mid_ranks, profile_columns, profile_predictions, duplicate_rows, row_filter_recode, ols, hc3_ols, ancova, regression_f_test, iv_2sls, huber_regression, logistic_glm, logistic_regret, poisson_regret, logrank_two, ancova_flag, probit_glm, firth_logistic, poisson_glm, negative_binomial_glm, tobit_regression, gee, mixed_effects, logrank, cox_ph, cox_ph_test, conjugate_bayes, posterior_predictive, randomization_inference, ipw, multiple_imputation, calibrated_logistic, calibration_curve, stratified_folds, brier_auc, calibration_bins, blocked_time_series_cv]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# SQL: distribution functions by Simpson's rule, with 2000 steps, as scalar subqueries.

_SIMPSON = "(SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}) * ({hi}) / 6000 FROM range(2001) r(i))"


def _integral(f: str, hi: str) -> str:
    """Of f over u from 0 to hi; f names u as (i * hi / 2000)."""
    return _SIMPSON.format(f=f.replace("{u}", f"(i * ({hi}) / 2000)"), hi=hi)


def _t_p(t: str, df: str) -> str:
    # u = atan(t / sqrt(df)) makes the density cos(u) ** (df - 1)
    area = _integral(f"pow(cos({{u}}), {df} - 1)", f"atan(abs({t}) / sqrt({df}))")
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area})"


def _z_p(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_integral('exp(-{u} * {u} / 2)', f'least(abs({z}), 12)')})"


def _chi2_p(x: str, df: str) -> str:
    area = _integral(f"pow({{u}}, {df} - 1) * exp(-{{u}} * {{u}} / 2)", f"least(sqrt({x}), 30)")
    return f"greatest(0, 1 - exp((1 - {df} / 2) * ln(2) - lgamma({df} / 2)) * {area})"


_FLAGS = "(SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


def _t_sql(source: str, y: str, g: str, pooled: bool, df: str) -> str:
    cols = "first_level, second_level, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(m2 - m1, 6) AS mean_difference, round(se, 6) AS std_error, round(df, 6) AS df, round((m1 - m2) / se, 6) AS statistic"
    se = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))" if pooled else "sqrt(v1 / n1 + v2 / n2)"
    dof = "(n1 + n2 - 2)::DOUBLE" if pooled else "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"
    return f"""
WITH d AS (SELECT {y}::DOUBLE AS y, {g}::VARCHAR AS g FROM {source} WHERE {y} IS NOT NULL AND NOT isnan({y}::DOUBLE) AND {g} IS NOT NULL),
l AS (SELECT min(g) AS first_level, max(g) AS second_level FROM d),
a AS (SELECT first_level, second_level, count(*) FILTER (g = first_level) AS n1, count(*) FILTER (g = second_level) AS n2,
  avg(y) FILTER (g = first_level) AS m1, avg(y) FILTER (g = second_level) AS m2,
  var_samp(y) FILTER (g = first_level) AS v1, var_samp(y) FILTER (g = second_level) AS v2 FROM d, l GROUP BY ALL),
b AS (SELECT *, {se} AS se, {dof} AS df FROM a),
c AS (SELECT *, (m1 - m2) / se AS t FROM b)
SELECT {cols} {df} FROM c"""


_PAIRS = """(SELECT struct_extract(min(row(l_linenumber, l_extendedprice)), 2) AS a, struct_extract(max(row(l_linenumber, l_extendedprice)), 2) AS b
  FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"""


def _rank_sql(source: str, y: str, g: str) -> str:
    return f"""
d AS (SELECT {y}::DOUBLE AS v, {g} AS g FROM {source} WHERE {y} IS NOT NULL AND {g} IS NOT NULL),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v)::DOUBLE AS t FROM d)"""


_PRED = "(SELECT valid::INT AS valid, CASE WHEN isnan(normalized_regret) THEN NULL ELSE normalized_regret END AS regret, normalized_regret, language, domain FROM predictions)"


def _profile_sql(source: str, cols: list[str], levels: bool) -> str:
    parts = []
    for c in cols:
        v = f"nullif({c}::VARCHAR, 'nan')"
        num = f"try_cast({v} AS DOUBLE)"
        lv = f", CASE WHEN count(DISTINCT {v}) <= 20 THEN string_agg(DISTINCT {v}, '|' ORDER BY {v}) END AS levels" if levels else f", round(avg(({num} = 0)::INT), 6) AS zero_fraction"
        parts.append(f"SELECT '{c}' AS name, count(*) - count({v}) AS missing, count(DISTINCT {v}) AS \"unique\", round(min({num}), 6) AS minimum, round(max({num}), 6) AS maximum{lv} FROM {source}")
    return "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    p_t = f", round({_t_p('t', 'df')}, 6) AS p_value"
    out = {
        "contingency_table": "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) LEFT JOIN lineitem USING (l_returnflag, l_linestatus) GROUP BY ALL",
        "mid_ranks": "SELECT l_quantity, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS mid_rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY l_quantity",
        "profile_columns": _profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], False),
        "profile_predictions": _profile_sql("predictions", ["adapter_id", "language", "normalized_regret", "valid"], True),
        "duplicate_rows": "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM predictions GROUP BY blueprint_id, adapter_id, language, predicted_method_id, normalized_regret)",
        "row_filter_recode": "SELECT language, domain, count(*) AS n, sum((predicted_method_id IN ('ols', 'welch_t'))::INT)::BIGINT AS positives FROM predictions WHERE (language IS NULL OR language <> 'en') AND domain IN ('inference_and_design', 'probability_and_bayes') GROUP BY ALL",
        "paired_t": f"""
WITH a AS (SELECT count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) / sqrt(count(*)) AS se FROM {_PAIRS}), c AS (SELECT *, (n - 1)::DOUBLE AS df, m / se AS t FROM a)
SELECT n AS n_pairs, round(m, 6) AS mean_difference, round(se, 6) AS std_error, df, round(t, 6) AS statistic{p_t} FROM c""",
        "mann_whitney": f"""
WITH {_rank_sql(_FLAGS, 'l_quantity', 'l_returnflag')},
s AS (SELECT count(*) FILTER (g = 'A')::DOUBLE AS n1, count(*) FILTER (g = 'R')::DOUBLE AS n2, sum(r) FILTER (g = 'A') AS r1, sum(t * t - 1) AS tie FROM r),
z AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)
SELECT 'A' AS first_level, 'R' AS second_level, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS statistic, round(greatest(z, 0), 6) AS z, round({_z_p('greatest(z, 0)')}, 6) AS p_value, false AS exact FROM z""",
        "stratified_folds": """
WITH d AS (SELECT valid::INT AS y FROM predictions WHERE valid IS NOT NULL AND normalized_regret IS NOT NULL AND NOT isnan(normalized_regret)),
c AS (SELECT y, count(*) AS n FROM d GROUP BY y),
f AS (SELECT y, k AS fold, n // 5 + (k < n % 5)::INT AS m FROM c, range(5) x(k))
SELECT fold::INT AS fold, sum(m)::BIGINT AS n, sum(m) FILTER (y = 1)::BIGINT AS n_valid FROM f GROUP BY fold""",
        "wilcoxon_signed_rank": f"""
WITH d AS (SELECT abs(b - a) AS v, b > a AS g FROM {_PAIRS} WHERE a <> b),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v)::DOUBLE AS t FROM d),
s AS (SELECT count(*)::DOUBLE AS n, sum(r) FILTER (g) AS w, sum(t * t - 1) AS tie FROM r),
z AS (SELECT *, (w - n * (n + 1) / 4 - 0.5 * sign(w - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM s)
SELECT n::BIGINT AS n_pairs, round(w, 6) AS statistic, round(z, 6) AS z, round({_z_p('z')}, 6) AS p_value FROM z""",
        "kruskal_wallis": f"""
WITH {_rank_sql('orders', 'o_totalprice', 'o_orderpriority')},
p AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS r, sum(t * t - 1) AS tie FROM r GROUP BY g),
h AS (SELECT count(*) AS k, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - sum(tie) / (pow(sum(n), 3) - sum(n))) AS h FROM p)
SELECT k AS n_groups, n::BIGINT AS n, round(h, 6) AS statistic, k - 1 AS df, round({_chi2_p('h', '(k - 1)')}, 6) AS p_value FROM h""",
        "spearman_correlation": f"""
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part),
c AS (SELECT count(*) AS n, corr(a, b) AS rho FROM r), t AS (SELECT *, (n - 2)::DOUBLE AS df, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c)
SELECT n, round(rho, 6) AS rho{p_t} FROM t""",
        "brier_auc": f"""
WITH d AS (SELECT 1 - regret AS v, valid AS g FROM {_PRED} WHERE regret IS NOT NULL AND valid IS NOT NULL),
r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM d)
SELECT count(*) AS n, round(avg(pow(v - g, 2)), 6) AS brier, round((sum(r) FILTER (g = 1) - sum(g) * (sum(g) + 1) / 2) / (sum(g) * (count(*) - sum(g))), 6) AS auc FROM r""",
        "calibration_bins": f"""
WITH d AS (SELECT 1 - regret AS v, valid AS g FROM {_PRED} WHERE regret IS NOT NULL AND valid IS NOT NULL),
q AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM d)
SELECT len(list_filter(q, lambda x : v > x))::INT AS bin, count(*) AS n, round(avg(v), 6) AS mean_score, round(avg(g), 6) AS observed_rate FROM d, q GROUP BY 1""",
        "conjugate_bayes": """
WITH a AS (SELECT count(c_acctbal) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer), b AS (SELECT n, (n * m / v) / (0.01 + n / v) AS pm, 1 / sqrt(0.01 + n / v) AS ps FROM a)
SELECT n, round(pm, 6) AS posterior_mean, round(ps, 6) AS posterior_sd, round(pm - 1.9599639845400545 * ps, 6) AS ci_low, round(pm + 1.9599639845400545 * ps, 6) AS ci_high FROM b""",
        "multiple_imputation": "SELECT count(*) AS n, count(*) FILTER (language IS NOT NULL AND normalized_regret IS NOT NULL AND valid IS NOT NULL) AS complete_cases, sum((language IS NULL)::INT + (normalized_regret IS NULL)::INT + (valid IS NULL)::INT)::BIGINT AS missing_cells, 3 AS n_columns FROM predictions",
    }
    newton = """WITH RECURSIVE d AS ({data}), f AS (SELECT 0 AS i, {a0}::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 UNION ALL
SELECT i + 1, a + (t2 * u0 - t1 * u1) / (t0 * t2 - t1 * t1), b + (t0 * u1 - t1 * u0) / (t0 * t2 - t1 * t1), t0, t1, t2 FROM
  (SELECT i, a, b, sum({w}) AS t0, sum({w} * x) AS t1, sum({w} * x * x) AS t2, sum(y - m) AS u0, sum(x * (y - m)) AS u1 FROM (SELECT f.i, f.a, f.b, x, y, {m} AS m FROM f, d) GROUP BY i, a, b) WHERE i < 25),
v AS (SELECT 'const' AS term, a AS est, sqrt(s2 / (s0 * s2 - s1 * s1)) AS se FROM f WHERE i = 25 UNION ALL SELECT '{x}', b, sqrt(s0 / (s0 * s2 - s1 * s1)) FROM f WHERE i = 25)
SELECT term, round(est, 5) AS estimate, round(se, 5) AS std_error, round(est / se, 5) AS statistic, round({p}, 5) AS p_value FROM v"""
    z = _z_p("(est / se)")
    out["logistic_regret"] = newton.format(data=f"SELECT regret AS x, valid AS y FROM {_PRED} WHERE regret IS NOT NULL AND valid IS NOT NULL", a0="0.0", w="m * (1 - m)", m="1 / (1 + exp(-(f.a + f.b * x)))", x="regret", p=z)
    out["poisson_regret"] = newton.format(data="SELECT avg(value) AS x, count(*) AS y FROM events GROUP BY user_id, event_type HAVING avg(value) IS NOT NULL", a0="1.0", w="m", m="exp(f.a + f.b * x)", x="mean_value", p=z)
    out["logrank_two"] = f"""WITH t AS (SELECT user_id, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS tp, arg_min(event_type, row(epoch_us(ts), event_id)) AS first_type FROM events GROUP BY 1),
u AS (SELECT round((coalesce(tp, t1) - t0) / 3.6e9, 3) AS t, tp IS NOT NULL AS e, coalesce(first_type = 'click', false) AS g FROM t),
k AS (SELECT t, count(*) AS n, count(*) FILTER (g) AS n1, count(*) FILTER (e) AS d, count(*) FILTER (e AND g) AS d1 FROM u GROUP BY t),
r AS (SELECT *, sum(n) OVER (ORDER BY t DESC)::DOUBLE AS rn, sum(n1) OVER (ORDER BY t DESC)::DOUBLE AS r1 FROM k),
s AS (SELECT sum(d1 - d * r1 / rn) AS u, sum(CASE WHEN rn > 1 THEN d * (rn - d) / (rn - 1) * r1 / rn * (1 - r1 / rn) ELSE 0 END) AS v, sum(n)::BIGINT AS n FROM r)
SELECT n, 2 AS n_groups, round(u * u / v, 6) AS statistic, 1 AS df, round({_z_p('(u / sqrt(v))')}, 6) AS p_value FROM s"""
    out["ancova_flag"] = f"""WITH d AS (SELECT l_extendedprice AS y, (l_returnflag = 'R')::INT::DOUBLE AS g, l_quantity::DOUBLE AS q FROM {_FLAGS}),
c AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(g) AS mg, avg(q) AS mq, regr_sxx(g, g) AS gg, regr_sxx(q, q) AS qq, regr_sxy(q, g) AS gq, regr_sxy(y, g) AS gy, regr_sxy(y, q) AS qy FROM d),
b AS (SELECT *, gg * qq - gq * gq AS det, (qq * gy - gq * qy) / (gg * qq - gq * gq) AS bg, (gg * qy - gq * gy) / (gg * qq - gq * gq) AS bq FROM c),
l AS (SELECT (y - my - bg * (g - mg) - bq * (q - mq)) AS e, (qq * (g - mg) - gq * (q - mq)) / det AS zg, (gg * (q - mq) - gq * (g - mg)) / det AS zq, (g - mg) AS cg, (q - mq) AS cq, n, mg, mq FROM d, b),
h AS (SELECT *, 1 / n + cg * zg + cq * zq AS h FROM l),
w AS (SELECT *, pow(e / (1 - h), 2) AS w, 1 / n - mg * zg - mq * zq AS zc FROM h),
v AS (SELECT sqrt(sum(w * zc * zc)) AS sc, sqrt(sum(w * zg * zg)) AS sg, sqrt(sum(w * zq * zq)) AS sq FROM w)
SELECT 'const' AS term, round(my - bg * mg - bq * mq, 3) AS estimate, round(sc, 3) AS std_error FROM b, v UNION ALL SELECT 'g', round(bg, 3), round(sg, 3) FROM b, v UNION ALL SELECT 'l_quantity', round(bq, 3), round(sq, 3) FROM b, v"""
    out["fisher_exact"] = f"""WITH t AS (SELECT min(l_returnflag) AS g, (SELECT min(l_linestatus) FROM {_FLAGS}) AS o FROM {_FLAGS}),
c AS (SELECT count(*) FILTER (l_returnflag = g AND l_linestatus = o) AS a, count(*) FILTER (l_returnflag = g AND l_linestatus <> o) AS b, count(*) FILTER (l_returnflag <> g AND l_linestatus = o) AS c, count(*) FILTER (l_returnflag <> g AND l_linestatus <> o) AS d FROM {_FLAGS}, t),
k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM c),
p AS (SELECT *, -lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp, -lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM k),
m AS (SELECT max(lp) AS m FROM p)
SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(any_value(CASE WHEN b * c > 0 THEN a * d / (b * c)::DOUBLE END), 6) AS odds_ratio, round(least(1, sum(exp(lp - m)) FILTER (lp <= own + 1e-7) / sum(exp(lp - m))), 6) AS p_value FROM p, m"""
    tail = "list_sum(list_transform(range({lo}, {hi}), lambda j : exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({q}) + (n - j) * ln(1 - {q}))))"
    out["binomial_test"] = f"""WITH RECURSIVE c AS (SELECT count(valid) AS n, count(*) FILTER (valid) AS k FROM predictions),
f AS (SELECT 0 AS i, n, k, 1e-9::DOUBLE AS a, k / n::DOUBLE AS b, k / n::DOUBLE AS c, 1 - 1e-9::DOUBLE AS d FROM c UNION ALL
  SELECT i + 1, n, k, CASE WHEN l THEN (a + b) / 2 ELSE a END, CASE WHEN l THEN b ELSE (a + b) / 2 END, CASE WHEN h THEN (c + d) / 2 ELSE c END, CASE WHEN h THEN d ELSE (c + d) / 2 END FROM
  (SELECT *, {tail.format(lo='k', hi='n + 1', q='((a + b) / 2)')} < 0.025 AS l, {tail.format(lo='0', hi='k + 1', q='((c + d) / 2)')} > 0.025 AS h FROM f) WHERE i < 40),
p AS (SELECT n, k, list_transform(range(0, n + 1), lambda j : lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + n * ln(0.5)) AS lp FROM c)
SELECT n, k AS successes, round(k / n, 6) AS estimate, round(least(1, list_sum(list_transform(list_filter(lp, lambda x : x <= lp[k + 1] + 1e-7), lambda x : exp(x)))), 6) AS p_value, (SELECT round(a, 6) FROM f WHERE i = 40) AS ci_low, (SELECT round(d, 6) FROM f WHERE i = 40) AS ci_high FROM p"""
    for name, source, y, g, pooled in (("welch_t", _FLAGS, "l_extendedprice", "l_returnflag", False), ("independent_t", _FLAGS, "l_extendedprice", "l_returnflag", True), ("difference_in_means", _PRED, "regret", "valid", False)):
        q = _t_q("df")
        out[name] = _t_sql(source, y, g, pooled, f"{p_t}, round(m2 - m1 - {q} * se, 6) AS ci_low, round(m2 - m1 + {q} * se, 6) AS ci_high")
    out["paired_t"] = out["paired_t"].replace(" FROM c", f", round(m - {_t_q('df')} * se, 6) AS ci_low, round(m + {_t_q('df')} * se, 6) AS ci_high FROM c")
    cell = """
WITH n AS (SELECT l_returnflag AS g, l_linestatus AS o, count(*) AS n FROM {src} GROUP BY ALL),
f AS (SELECT g, o, coalesce(n, 0) AS n FROM (SELECT DISTINCT g FROM n) CROSS JOIN (SELECT DISTINCT o FROM n) LEFT JOIN n USING (g, o)),
e AS (SELECT n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY o) / sum(n) OVER ()::DOUBLE AS e FROM f),
s AS (SELECT sum(n)::BIGINT AS n, sum(pow(abs(n - e) - {y}, 2) / e) AS x, min(e) AS me, (SELECT (count(DISTINCT g) - 1) * (count(DISTINCT o) - 1) FROM f) AS df FROM e)
SELECT n, round(x, 6) AS statistic, df, round(me, 6) AS min_expected, round({p}, 6) AS p_value FROM s"""
    out["chi_square"] = cell.format(src="lineitem", y="0", p=_chi2_p("x", "df"))
    out["two_proportion"] = cell.format(src=_FLAGS, y="least(0.5, abs(n - e))", p=_chi2_p("x", "df"))
    reg = "WITH r AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem), e AS (SELECT r.*, (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) FROM lineitem) AS rss FROM r)"
    both = "SELECT term, round(est, 4) AS estimate, round(se, 4) AS std_error, round(est / se, 4) AS statistic, {p} AS p_value, round(est - {q} * se, 4) AS ci_low, round(est + {q} * se, 4) AS ci_high FROM v"
    out["ols"] = f"{reg}, v AS (SELECT 'const' AS term, a AS est, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se, (n - 2)::DOUBLE AS df FROM e UNION ALL SELECT 'l_quantity', b, sqrt(rss / (n - 2) / sxx), (n - 2)::DOUBLE FROM e) " + both.format(p=f"round({_t_p('(est / se)', 'df')}, 4)", q=_t_q("df"))
    out["hc3_ols"] = f"{reg}, w AS (SELECT pow(l_extendedprice - a - b * l_quantity, 2) / pow(1 - (1.0 / n + pow(l_quantity - mx, 2) / sxx), 2) AS w, l_quantity - mx AS c, n, mx, sxx, a, b FROM lineitem, e), m AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(mx) AS mx, sum(w * pow(1.0 / n - mx * c / sxx, 2)) AS va, sum(w * pow(c / sxx, 2)) AS vb FROM w), v AS (SELECT 'const' AS term, a AS est, sqrt(va) AS se FROM m UNION ALL SELECT 'l_quantity', b, sqrt(vb) FROM m) " + both.format(p=f"round({_z_p('(est / se)')}, 4)", q="1.9599639845400545")
    out["regression_f_test"] = f"{reg} SELECT n, round((syy - rss) / (rss / (n - 2)), 4) AS statistic, 1 AS df_model, (n - 2)::INT AS df_resid, round(1 - rss / syy, 4) AS r_squared, round({_t_p('sqrt((syy - rss) / (rss / (n - 2)))', '(n - 2)::DOUBLE')}, 4) AS p_value FROM e"
    iv = "SELECT covar_samp(l_extendedprice, l_quantity + 40 * l_tax) / covar_samp(l_quantity, l_quantity + 40 * l_tax) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem"
    out["iv_2sls"] = f"WITH r AS ({iv}) SELECT 'const' AS term, round(my - b * mx, 4) AS estimate FROM r UNION ALL SELECT 'l_quantity', round(b, 4) FROM r"
    return out


def _t_q(df: str) -> str:
    """The 97.5 % point of t for many degrees of freedom, by its series around the normal point."""
    z = 1.9599639845400545
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return "(" + repr(z) + "".join(f" + {c!r} / pow({df}, {i})" for i, c in enumerate(terms, 1)) + ")"
