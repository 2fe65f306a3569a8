"""Evaluation of predictions: grouped metrics, paired comparison, gates, thresholds, routing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.dist import norm_ppf
from lodestat.operators.ordering import hash_order


def accuracy_rollup(df: DataFrame, correct: Column, by: Sequence[str]) -> DataFrame:
    """Accuracy overall and by each column alone, in one pass over grouping sets."""
    d = df.withColumn("__c", correct.cast("double"))
    return d.groupingSets([[], *[[c] for c in by]], *by).agg(F.grouping_id().alias("level"), F.count("__c").alias("n"), F.round(F.avg("__c"), 4).alias("accuracy"))


def selector_metrics(df: DataFrame, by: Sequence[str], cube: bool = False) -> DataFrame:
    """Mean regret, accuracy and invalid rate per grouping set; NaN regrets count as missing."""
    regret = F.when(~F.isnan("normalized_regret"), F.col("normalized_regret"))
    aggs = [F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg(regret), 6).alias("mean_regret"), F.round(F.avg((F.col("predicted_method_id") == F.col("oracle_method_id")).cast("double")), 6).alias("accuracy"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate")]
    return df.cube(*by).agg(*aggs) if cube else df.groupingSets([[], *[[c] for c in by]], *by).agg(*aggs)


def macro_mean(df: DataFrame, outer: Sequence[str], inner: str, value: Column) -> DataFrame:
    """Mean over the inner groups' means, not pooled."""
    m = df.groupBy(*outer, inner).agg(F.avg(value).alias("m"))
    return m.groupBy(*outer).agg(F.count("m").alias("n_groups"), F.round(F.avg("m"), 6).alias("macro_mean"))


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, whole: bool = False) -> DataFrame:
    """Full outer pairing: difference a - b and whether both sides have the key. With `whole`, a key that only
    one side has is an error when the result is read."""
    x = a.select(*keys, F.col(value).alias("__a"))
    y = b.select(*keys, F.col(value).alias("__b"))
    x, y = x.withColumn("__in_a", F.lit(True)), y.withColumn("__in_b", F.lit(True))
    j = x.join(y, list(keys), "full_outer")
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    if whole:
        both = F.when(both, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("only one side has"), *[F.col(k).cast("string") for k in keys])).cast("boolean"))
    return j.select(*keys, (F.col("__a") - F.col("__b")).alias("difference"), (both & F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("paired"))


def paired_bootstrap(df: DataFrame, difference: str, key: str, draws: int = 10_000, seed: int = 0, low: float = 0.025, high: float = 0.975, held: int = 4_000_000) -> DataFrame:
    """Mean difference with a percentile interval. Resamples by Poisson(1) weights per row and draw, made
    in batches of a hash block: no resample is ever gathered, and equal seeds give equal results. A task
    holds `held` weights at once, however large a block is."""
    d = df.where(F.col(difference).isNotNull() & ~F.isnan(F.col(difference))).select(F.col(key).cast("string").alias("k"), F.col(difference).cast("double").alias("d"))
    d = d.withColumn("block", F.pmod(hash_order(seed, "k"), F.lit(4096)).cast("int"))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(["k", "d"])["d"].to_numpy()
        rng, step = np.random.default_rng((seed, int(k[0]))), max(1, held // draws)
        total, weight = np.zeros(draws), np.zeros(draws)
        for at in range(0, len(y), step):
            part = y[at : at + step]
            w = rng.poisson(1.0, (draws, len(part))).astype(float)
            total += w @ part
            weight += w.sum(1)
        return pd.DataFrame({"r": np.arange(draws, dtype="int32"), "s": total, "w": weight})

    sums = d.groupBy("block").applyInPandas(run, "r int, s double, w double").groupBy("r").agg((F.sum("s") / F.sum("w")).alias("m"))
    ci = sums.agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("q"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean")).crossJoin(ci).select("n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def power_sample_size(effect: float, sd: float, alpha: float = 0.05, power: float = 0.8, margin: float = 0.0, multiple: int = 1) -> int:
    """Pairs needed for a one-sided comparison against a margin, up to a multiple."""
    if effect <= margin:
        raise ValueError("the effect must exceed the margin")
    n = ((norm_ppf(1 - alpha) + norm_ppf(power)) * sd / (effect - margin)) ** 2
    return max(multiple, math.ceil(math.ceil(n) / multiple) * multiple)


def non_inferiority(parent: DataFrame, candidate: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Per key: both values, within tolerance or not; a key on one side only fails."""
    j = parent.select(*keys, F.col(value).alias("parent_value")).join(candidate.select(*keys, F.col(value).alias("candidate_value")), list(keys), "full_outer")
    return j.withColumn("passed", F.coalesce(F.round(F.col("candidate_value") - F.col("parent_value"), 12) <= tolerance, F.lit(False)))


def threshold_sweep(df: DataFrame, score: str, hit: Column, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: routed rows, hits among them. Rows are counted once per score class, thresholds
    are then met by running sums over the few classes."""
    edges = sorted(thresholds)
    cls = F.lit(0)
    for t in edges:
        cls = cls + (F.col(score) >= t).cast("int")
    per = df.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("h"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(edges)], "i int, threshold double")
    return grid.join(per, F.col("cls") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("routed"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


def routed_pick(decisions: DataFrame, predictions: DataFrame, on: Sequence[str], fallback: str = "parent") -> DataFrame:
    """The prediction of the chosen expert; where it is missing, that of the fallback slug."""
    pick = decisions.join(predictions, [*on, "slug"], "left")
    spare = predictions.where(F.col("slug") == fallback).drop("slug")
    cols = [c for c in predictions.columns if c not in (*on, "slug")]
    j = pick.join(spare.select(*on, *[F.col(c).alias(f"__{c}") for c in cols]), list(on), "left")
    return j.select(*on, "slug", *[F.coalesce(c, f"__{c}").alias(c) for c in cols])


def guarded(df: DataFrame, fires: Column, method: str = "predicted_method_id", regret: str = "normalized_regret") -> DataFrame:
    """Where the guard fires the method is a request for clarification: regret 1, invalid."""
    return df.withColumns({method: F.when(fires, "needs_clarification").otherwise(F.col(method)), regret: F.when(fires, 1.0).otherwise(F.col(regret)), "valid": F.when(fires, False).otherwise(F.col("valid"))})


def replaced(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the other table has are replaced by its rows."""
    return rows.join(other, list(keys), "left_anti").unionByName(other.select(*rows.columns))


def best_by(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the first in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("__r = 1").drop("__r")


def pairwise_cosine(df: DataFrame, key: str, vector: str, label: str, blocks: int = 16) -> DataFrame:
    """Mean cosine within and across labels over all ordered pairs of different rows: sums of unit vectors
    give all pair sums, so no pair is formed."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = df.select(label, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("i", "v"), norm.alias("norm")).where("norm > 0")
    per = unit.groupBy(label, "i").agg(F.sum(F.col("v") / F.col("norm")).alias("s"))
    n = df.withColumn("norm", norm).where("norm > 0").groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    own = per.groupBy(label).agg(F.sum(F.col("s") ** 2).alias("own")).join(n, label)
    all_ = per.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") ** 2).alias("all"))
    w = own.agg(F.sum(F.col("own") - F.col("n")).alias("w"), F.sum("own").alias("o"), F.sum(F.col("n") * (F.col("n") - 1)).alias("wn"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    return w.crossJoin(all_).select("n", F.round(F.col("w") / F.col("wn"), 6).alias("mean_within"), F.round((F.col("all") - F.col("o")) / (F.col("n") ** 2 - F.col("nn")), 6).alias("mean_across"))
