"""Choices over grids, whole groups, menus and mutations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.dist import norm_ppf
from lodestat.operators.ordering import hash_order, running_totals, value_slices
from lodestat.operators.skew import salted_join
from lodestat.session import cut


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does: cheap rules go first."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def admitted(df: DataFrame, key: str, early: Sequence[tuple[str, Column]], cell: Sequence[str], quota: int, digest: str, benchmark: DataFrame, late: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`: the first of the early rules that holds; `quota` beyond the first rows, by key, of a cell among those
    left; `duplicate` behind the first row with the same digest; `benchmark_overlap` where the benchmark has it; the
    first late rule; else `admitted`. `benchmark` has one column of distinct digests, named as in df.

    Quota is counted before copies are taken out, as rows are met one by one. Places in a cell and among copies
    come from running counts over slices of the keys, so neither is sorted in one task."""
    d = df.withColumn("__early", first_reason(early))
    free = F.when(F.col("__early").isNull(), 1).otherwise(0)
    d, at = value_slices(d, key)
    d = running_totals(d, list(cell), key, {"__place": free}, slice_of=at)
    inside = F.col("__early").isNull() & (F.col("__place") <= quota)
    d, at = value_slices(d.withColumn("__inside", inside), key)
    d = running_totals(d, [digest], key, {"__copy": F.when(F.col("__inside"), 1).otherwise(0)}, slice_of=at)
    known = benchmark.withColumn("__known", F.lit(True))
    d = salted_join(cut(d), known, [digest], F.col(key), "left")
    rest = [("quota", ~F.col("__inside")), ("duplicate", F.col("__copy") > 1), ("benchmark_overlap", F.col("__known")), *late]
    return d.withColumn("reason", F.coalesce("__early", first_reason(rest), F.lit("admitted"))).drop("__early", "__place", "__inside", "__copy", "__known")


def temperature_choice(df: DataFrame, score: str, correct: Column, grid: Sequence[float]) -> DataFrame:
    """(temperature, nll, accuracy, n, chosen): mean negative log-likelihood of a two-sided score logit / T per
    temperature, in one pass with a column per temperature; chosen is the least (nll, -accuracy, temperature)."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(score)))
    z = F.log(p / (1 - p))
    hit = correct.cast("double")
    cols = []
    for i, t in enumerate(grid):
        q = 1 / (1 + F.exp(-z / t))
        cols.append(F.avg(-(hit * F.log(F.greatest(q, F.lit(1e-300))) + (1 - hit) * F.log(F.greatest(1 - q, F.lit(1e-300))))).alias(f"t{i}"))
    right = F.avg(((F.col(score) >= 0.5) == (hit == 1)).cast("double")).alias("accuracy")
    row = df.where(F.col(score).isNotNull() & hit.isNotNull()).agg(F.count(F.lit(1)).alias("n"), right, *cols)
    pairs = F.array(*[F.struct(F.round(f"t{i}", 6).alias("nll"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(grid)])
    rows = row.select("n", F.round("accuracy", 6).alias("accuracy"), F.array_min(pairs).alias("best"), F.explode(pairs).alias("p"))
    return rows.select("p.temperature", "p.nll", "accuracy", "n", (F.col("p") == F.col("best")).alias("chosen"))


def complete_groups(df: DataFrame, group: str, slot: str, slots: Sequence[str]) -> DataFrame:
    """(group, complete, n): whether a group has exactly the wanted slots, each once."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(slot)).alias("have"))
    return g.select(group, ((F.col("n") == len(slots)) & (F.col("have") == F.array(*[F.lit(s) for s in sorted(slots)]))).alias("complete"), "n")


def replay_sample(new: DataFrame, old: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """All new rows and whole old groups, in hash order, so that old groups are `fraction` of all groups;
    rows are tagged. The number of new groups is counted first."""
    n = new.select(group).distinct().count()
    take = round(n * fraction / (1 - fraction))
    keys = old.select(group).distinct().orderBy(hash_order(seed, F.col(group)), group).limit(take)
    return new.withColumn("part", F.lit("new")).unionByName(old.join(keys, group, "left_semi").select(*new.columns).withColumn("part", F.lit("replay")))


def importance_weights(df: DataFrame, by: str, desired: Mapping[str, float]) -> DataFrame:
    """(category, n, weight): desired share over observed frequency; categories without a wish weigh 0."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("all"))
    want = F.lit(0.0)
    for k, v in desired.items():
        want = F.when(F.col(by) == k, float(v)).otherwise(want)
    return g.crossJoin(t).select(by, "n", F.round(want / (F.col("n") / F.col("all")), 6).alias("weight"))


def menu(candidates: Column, key: Column, seed: int = 0, clarify: str = "needs_clarification", most: int = 6) -> Column:
    """Candidates and the request for clarification in a hash order, labelled A, B, ...; null if there are
    more options than the `most` labels, as no option may be lost."""
    all_ = F.array_union(candidates, F.array(F.lit(clarify)))
    mixed = F.array_sort(F.transform(all_, lambda m: F.struct(hash_order(seed, key, m).alias("h"), m.alias("m"))))
    return F.when(F.size(all_) <= most, F.transform(mixed, lambda s, i: F.struct(F.char(i + 65).alias("label"), s["m"].alias("method"))))


def mutated(parameters: Column, key: Column, low: Column, high: Column, whole: Column, seed: int = 0, two: float = 0.35) -> Column:
    """One parameter, or with probability `two` two of them, moved by 4 to 18 % of its range, up or down, clipped;
    whole numbers stay whole and at least 2. Which ones, by hash. low, high, whole: maps by parameter name;
    names without bounds stay as they are."""
    u = lambda tag, *k: hash_order(seed, F.lit(tag), key, *k).cast("double") / float(1 << 63)
    bounded = F.filter(F.map_keys(parameters), lambda k: F.try_element_at(low, k).isNotNull() & F.try_element_at(parameters, k).isNotNull())
    order = F.array_sort(F.transform(bounded, lambda k: F.struct(hash_order(seed, F.lit("which"), key, k).alias("h"), k.alias("k"))))
    chosen = F.transform(F.slice(order, 1, F.when(u("two") < two, 2).otherwise(1)), lambda s: s["k"])

    def move(k: Column, v: Column) -> Column:
        lo, hi = F.try_element_at(low, k), F.try_element_at(high, k)
        step = (0.04 + 0.14 * u("size", k)) * F.when(u("sign", k) < 0.5, -1.0).otherwise(1.0) * (hi - lo)
        new = F.greatest(lo, F.least(hi, v + step))
        new = F.when(F.coalesce(F.try_element_at(whole, k), F.lit(False)), F.greatest(F.round(new), F.lit(2.0))).otherwise(new)
        return F.when(F.array_contains(chosen, k), new).otherwise(v)

    return F.transform_values(parameters, move)


def capped_picks(df: DataFrame, family: str, method: str, key: str, reward: str, count: int, family_cap: int | None = None, method_cap: int | None = None) -> DataFrame:
    """`count` rows: first, in the order of the families' names, the best row of each by (reward, key) whose method
    is not at its cap; then the best of all, with at most family_cap per family and method_cap per method
    over the whole selection. Adds `rank`, the order of the picks.

    A row can only be taken if fewer than the smaller cap of rows of its family and method are better, so
    what is left of each such cell, at most that many rows, goes through one task: families x methods x cap
    rows, whatever the table's size."""
    if count < 0 or any(c is not None and c <= 0 for c in (family_cap, method_cap)):
        raise ValueError("count must not be negative, caps must be positive")
    most = min(count, *(c for c in (family_cap, method_cap) if c is not None)) if family_cap or method_cap else count
    w = Window.partitionBy(family, method).orderBy(F.desc(reward), key)
    d = df.withColumn("__m", F.row_number().over(w)).where(F.col("__m") <= most).drop("__m")
    schema = T.StructType([*d.schema.fields, T.StructField("rank", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([reward, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        families, methods = pdf[family].tolist(), pdf[method].tolist()
        per_family: Counter = Counter()
        per_method: Counter = Counter()
        taken: list[int] = []

        def take(i: int) -> bool:
            full = (family_cap is not None and per_family[families[i]] >= family_cap) or (method_cap is not None and per_method[methods[i]] >= method_cap)
            if full or len(taken) >= count:
                return False
            taken.append(i)
            per_family[families[i]] += 1
            per_method[methods[i]] += 1
            return True

        for f in sorted(set(families), key=str):
            any(take(i) for i in range(len(families)) if families[i] == f)
        chosen = set(taken)
        for i in range(len(families)):
            if i not in chosen:
                take(i)
        out = pdf.loc[taken].copy()
        out["rank"] = range(1, len(taken) + 1)
        return out

    columns = d.columns
    return d.groupBy(F.lit(1).alias("__one")).applyInPandas(lambda pdf: pick(pdf[columns]), schema)


def min_norm_weights(gram: np.ndarray, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Weights on the simplex with the least norm of the mixed vector, by Frank-Wolfe with exact steps."""
    g = np.asarray(gram, float)
    w = np.full(len(g), 1.0 / len(g))
    for _ in range(rounds):
        grad = g @ w
        i = int(np.argmin(grad))
        gap = w @ grad - grad[i]
        if gap <= tol:
            break
        d = -w.copy()
        d[i] += 1.0
        curve = d @ g @ d
        w = w + min(1.0, gap / curve if curve > 0 else 1.0) * d
    return w


def conflict_summary(gram: np.ndarray) -> dict[str, float]:
    """Cosines of a Gram matrix: share of negative pairs, mean, and the effective rank."""
    g = np.asarray(gram, float)
    n = np.sqrt(np.maximum(np.diag(g), 1e-300))
    c = (g / np.outer(n, n))[np.triu_indices(len(g), 1)]
    e = np.maximum(np.linalg.eigvalsh(g / np.outer(n, n)), 0)
    p = e[e > 0] / e.sum()
    return {"negative_share": float((c < 0).mean()), "mean_cosine": float(c.mean()), "effective_rank": float(np.exp(-(p * np.log(p)).sum()))}


def z_from_p(p: float) -> float:
    return -norm_ppf(min(max(p, 1e-300), 1.0) / 2)


def smooth_schedule(shares: Mapping[str, float], n: int) -> list[str]:
    """At every position the category that is furthest behind its share; ties by name."""
    total = sum(shares.values())
    had = dict.fromkeys(sorted(shares), 0)
    out = []
    for i in range(1, n + 1):
        k = max(had, key=lambda k: (shares[k] / total * i - had[k], [-ord(c) for c in k]))
        had[k] += 1
        out.append(k)
    return out
