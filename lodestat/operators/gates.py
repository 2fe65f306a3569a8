"""Checks and choices over metrics: guards, gates, picks, leave-one-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guard_metrics(df: DataFrame, truth: Column, fires: Column, by: Sequence[str]) -> DataFrame:
    """Sensitivity and specificity per group; rows with a null truth or guard are left out."""
    d = df.select(*by, truth.alias("t"), fires.alias("f")).where("t IS NOT NULL AND f IS NOT NULL")
    share = lambda want: F.round(F.avg(F.when(F.col("t") == want, (F.col("f") == want).cast("double"))), 6)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(True).alias("sensitivity"), share(False).alias("specificity"))


def gate_vector(metrics: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """One column per named gate, whether all passed, and the failed ones; a null gate fails."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in gates.items()}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in flags.items()]))
    return metrics.withColumns(flags).withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.col("failed") == "")


def check_table(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, n_rows, n_failed): all checks in one pass; a null check fails."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("n_failed")) for i, n in enumerate(checks)])
    return counts.select("n", F.explode(pairs).alias("p")).select("p.check_name", F.col("n").alias("n_rows"), "p.n_failed")


def role_picks(df: DataFrame, by: Sequence[str], key: str, hard: Sequence[Column], easy: Sequence[Column], n_hard: int, n_easy: int) -> DataFrame:
    """Per group the n first in the hard order are `repair`, of the rest the n first in the easy order
    `anchor`. Both orders keep only the top of a group ahead of the shuffle: the anchors are among the
    n_hard + n_easy first in the easy order, from which the repairs are taken out."""
    w = Window.partitionBy(*by)
    top = lambda order, n: df.withColumn("__r", F.row_number().over(w.orderBy(*order))).where(F.col("__r") <= n)
    repair = top(hard, n_hard).drop("__r")
    left = top(easy, n_hard + n_easy).join(repair.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    anchor = left.withColumn("__e", F.row_number().over(w.orderBy("__r"))).where(F.col("__e") <= n_easy).drop("__r", "__e")
    return repair.withColumn("role", F.lit("repair")).unionByName(anchor.withColumn("role", F.lit("anchor")))


def least_over_groups(metrics: DataFrame, *values: str) -> DataFrame:
    """The worst group of each metric: smallest value, one row."""
    return metrics.agg(*[F.min(v).alias(v) for v in values])


def eligible_best(candidates: DataFrame, gates: Mapping[str, Column], order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Of the candidates that pass all gates the first in the order, per group (`by`) or over all; all candidates
    come out, with the gates they failed and `chosen`. A null gate fails; without an eligible one none is chosen.
    Candidates are few (a grid, adapters, families), rows are not."""
    d = gate_vector(candidates, gates)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("passed"), *order)
    return d.withColumn("chosen", F.col("passed") & (F.row_number().over(w) == 1)).drop(*gates)


def guard_grid(df: DataFrame, truth: Column, score: Column, by: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """(threshold, sensitivity, specificity, min_sensitivity, min_specificity): pooled and in the worst group, for a
    guard that fires from a threshold on. One pass per group with a column per threshold."""
    d = df.select(*by, truth.alias("t"), score.alias("s")).where("t IS NOT NULL AND s IS NOT NULL")
    hits = [F.count(F.when(F.col("t") & (F.col("s") >= g), 1)).alias(f"h{i}") for i, g in enumerate(grid)]
    quiet = [F.count(F.when(~F.col("t") & (F.col("s") < g), 1)).alias(f"q{i}") for i, g in enumerate(grid)]
    per = d.groupBy(*by).agg(F.count(F.when(F.col("t"), 1)).alias("p"), F.count(F.when(~F.col("t"), 1)).alias("n"), *hits, *quiet)
    line = lambda i, g: F.struct(F.lit(float(g)).alias("threshold"), F.col(f"h{i}").alias("h"), F.col(f"q{i}").alias("q"))
    long = per.select("p", "n", F.explode(F.array(*[line(i, g) for i, g in enumerate(grid)])).alias("x")).select("p", "n", "x.*")
    rate = lambda a, b: F.when(b > 0, a / b)
    return long.groupBy("threshold").agg(
        F.round(F.sum("h") / F.sum("p"), 6).alias("sensitivity"), F.round(F.sum("q") / F.sum("n"), 6).alias("specificity"),
        F.round(F.min(rate(F.col("h"), F.col("p"))), 6).alias("min_sensitivity"), F.round(F.min(rate(F.col("q"), F.col("n"))), 6).alias("min_specificity"),
    )


def hash_picks(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """The first k per group in the order of a digest of seed and key."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(h, key))).where(F.col("pick") <= k)


def culprits(pairs: DataFrame, group: str, before: str, after: str) -> DataFrame:
    """Per group its part in the change of the overall mean, and the change without it."""
    per = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(after) - F.col(before)).alias("d"))
    t = per.agg(F.sum("n").alias("tn"), F.sum("d").alias("td"))
    out = per.crossJoin(t)
    rest = F.when(F.col("tn") > F.col("n"), (F.col("td") - F.col("d")) / (F.col("tn") - F.col("n")))
    six = lambda c: F.round(F.round(c, 9), 6)  # noqa: E731 (sums differ in their last digit by order)
    return out.select(group, "n", six(F.col("d") / F.col("n")).alias("mean_change"), six(F.col("d") / F.col("tn")).alias("contribution"), six(rest).alias("change_without"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """Weighted mean and effective sample size."""
    d = df.select(*by, value.alias("y"), weight.alias("w")).where("y IS NOT NULL AND w IS NOT NULL")
    return d.groupBy(*by).agg(F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 6).alias("weighted_mean"), F.round(F.sum("w") ** 2 / F.sum(F.col("w") * F.col("w")), 4).alias("effective_size"))
