"""Text router: naive Bayes over character n-grams.

Features are counted in Arrow batches and summed per class and feature before the one shuffle. The model, a
bounded vocabulary times the classes, travels with the tasks, so texts are scored where they lie.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.session import cut

_NUMBERS, _BLANKS = re.compile(r"[0-9]+(?:[.][0-9]+)?"), re.compile(r"[ \t\n\r\f\v]+")


def features(text: str, least: int, most: int, cap: int) -> dict[str, int]:
    """Character n-grams of a text in router form (compatibility forms to plain ones, lower case, numbers as 0,
    anchors) with their numbers, at most `cap` each."""
    t = _BLANKS.sub(" ", _NUMBERS.sub("0", unicodedata.normalize("NFKC", text).lower())).strip(" ")
    t = f"^{t}$"
    n: Counter = Counter()
    for size in range(least, most + 1):
        n.update(t[i : i + size] for i in range(len(t) - size + 1))
    return {g: min(c, cap) for g, c in n.items()}


def fit(df: DataFrame, key: str, text: str, label: str, least: int = 2, most: int = 4, vocabulary: int = 20_000, min_df: int = 2, alpha: float = 0.5, cap: int = 3, uniform_prior: bool = True) -> DataFrame:
    """The model as rows (class, feature, log_prob); feature null holds the log prior.

    The vocabulary are the features with the highest document frequency (ties by feature); counts per
    document are capped; smoothing adds alpha to every class and feature. Rows without text or label teach
    nothing. `key` is not read; it names the rows for callers that keep them."""
    d = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("class"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            docs: Counter = Counter()
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g, k in features(t, least, most, cap).items():
                    n[c, g] += k
                    docs[c, g] += 1
            at = list(n)
            cols = [[a[0] for a in at], [a[1] for a in at], [n[a] for a in at], [docs[a] for a in at]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["class", "feature", "n", "df"])

    counts = cut(d.mapInArrow(run, "class string, feature string, n bigint, df bigint").groupBy("class", "feature").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    vocab = counts.groupBy("feature").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "feature").limit(vocabulary).select("feature")
    docs = d.groupBy("class").agg(F.count(F.lit(1)).alias("docs"))
    grid = docs.select("class").crossJoin(vocab)  # classes times a bounded vocabulary
    size = vocab.agg(F.count(F.lit(1)).alias("v"))
    full = grid.join(counts.drop("df"), ["class", "feature"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = full.groupBy("class").agg(F.sum("n").alias("t"))
    probs = full.join(total, "class").crossJoin(size).select("class", "feature", F.log((F.col("n") + alpha) / (F.col("t") + alpha * F.col("v"))).cast("float").alias("log_prob"))
    every = docs.agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("k"))
    prior = F.when(F.lit(uniform_prior), -F.log(F.col("k"))).otherwise(F.log(F.col("docs") / F.col("all")))
    priors = docs.crossJoin(every).select("class", F.lit(None).cast("string").alias("feature"), prior.cast("float").alias("log_prob"))
    return probs.unionByName(priors)


def score(df: DataFrame, model: DataFrame, key: str, text: str, temperature: float = 1.0, least: int = 2, most: int = 4, cap: int = 3) -> DataFrame:
    """(key, predicted, confidence): prior plus the feature sum over the root of its weight; a text
    without known features has the prior, a null text none. Ties go to the smaller class. No shuffle; the
    model comes to the driver (classes times vocabulary)."""
    rows = model.collect()
    classes = sorted({r["class"] for r in rows})
    at = {c: i for i, c in enumerate(classes)}
    prior = np.zeros(len(classes))
    index: dict[str, int] = {}
    for r in rows:
        if r["feature"] is None:
            prior[at[r["class"]]] = r["log_prob"]
        else:
            index.setdefault(r["feature"], len(index))
    weights = np.zeros((len(index), len(classes)))
    for r in rows:
        if r["feature"] is not None:
            weights[index[r["feature"]], at[r["class"]]] = r["log_prob"]
    shared = df.sparkSession.sparkContext.broadcast((classes, prior, index, weights))
    schema = T.StructType([df.schema[key], T.StructField("predicted", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, prior, index, weights = shared.value
        for b in batches:
            best, sure = [], []
            for t in b.column(1).to_pylist():
                known = [(index[g], k) for g, k in features(t, least, most, cap).items() if g in index]
                s = prior.copy()
                if known:
                    rows, k = np.array([i for i, _ in known]), np.array([k for _, k in known], float)
                    s += k @ weights[rows] / np.sqrt(k.sum())
                s = s / temperature
                p = np.exp(s - s.max())
                i = int(np.argmax(s))
                best.append(classes[i])
                sure.append(float(p[i] / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], [key, "predicted", "confidence"])

    if not classes:
        return df.sparkSession.createDataFrame([], schema)
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def confusion(scored: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    return scored.join(truth, key).groupBy(F.col(label).alias("label"), "predicted").agg(F.count(F.lit(1)).alias("n"))


def canary_metrics(scored: DataFrame, truth: DataFrame, key: str, label: str, by: str, base: str, threshold: float) -> DataFrame:
    """Per value of `by` and over all (null): rows, share routed rightly (to the label's expert, or to the base where the
    label is null or not sure enough by the threshold) and share sent to a wrong expert."""
    d = truth.select(key, F.coalesce(F.col(label), F.lit(base)).alias("want"), by).join(scored, key)
    sent = F.when(F.col("confidence") >= threshold, F.col("predicted")).otherwise(base)
    d = d.withColumn("sent", sent)
    wrong = (F.col("sent") != base) & (F.col("sent") != F.col("want"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return d.groupingSets([[], [by]], by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), share(F.col("sent") == F.col("want")).alias("accuracy"), share(wrong).alias("wrong_expert_rate"))


def selective(decisions: DataFrame, mapped: Sequence[str], threshold: float, family: str = "predicted", confidence: str = "confidence", base: str = "parent") -> DataFrame:
    """The family's expert only where it is mapped and sure enough, else the base; a shorter mapping drops an expert."""
    go = F.col(family).isin(list(mapped)) & (F.col(confidence) >= threshold)
    return decisions.withColumn("route", F.when(F.coalesce(go, F.lit(False)), F.col(family)).otherwise(base))


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


__all__: Sequence[str] = ["canary_metrics", "confusion", "features", "fit", "load_model", "save_model", "score", "selective"]
