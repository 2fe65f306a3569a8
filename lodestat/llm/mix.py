"""Mixing sources to target shares of tokens (problem 9).

Entropy balancing: the rates nearest to 1 in relative entropy that meet the token constraints have
the form rate = min(cap, exp(lambda * tokens / mean tokens)), one multiplier per source. The dual is
convex; its Newton steps are distributed sums over a histogram of (source, tokens). Rates become whole
copies by systematic rounding along the documents sorted by length, so token sums stay near exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.keys import id_key
from lodestat.operators.ordering import hash_order, running_total
from lodestat.session import cut


def feasible_total(have: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest mix in which every source that holds tokens can give its share."""
    whole = sum(t for s, (t, _) in targets.items() if have.get(s))
    return min((have[s] * cap / (share / whole) for s, (share, cap) in targets.items() if have.get(s) and share > 0), default=0.0)


def solve_rates(hist: DataFrame, have: dict[str, tuple[int, float]], goal: dict[str, float], caps: dict[str, int], tolerance: float = 1e-9, steps: int = 60) -> dict[str, float]:
    """The multiplier per source. hist: (source, tokens, n). Newton steps, kept inside a bracket;
    each is one aggregation whose result has one line per source."""
    spark = hist.sparkSession
    lam = dict.fromkeys(goal, 0.0)
    lo: dict[str, float] = dict.fromkeys(goal, -math.inf)
    hi: dict[str, float] = dict.fromkeys(goal, math.inf)
    open_ = set()
    for s in goal:
        most = have[s][0] * caps[s]
        if goal[s] >= most * (1 - 1e-12):
            lam[s] = math.inf  # every copy is needed
        elif goal[s] <= 0:
            lam[s] = -math.inf
        else:
            open_.add(s)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], float(have[s][1]), float(caps[s])) for s in sorted(open_)], "source string, lam double, mean double, cap double")
        x = F.col("tokens") / F.col("mean")
        rate = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * x, F.lit(700.0))))
        free = F.when(rate < F.col("cap"), rate).otherwise(F.lit(0.0))
        sums = hist.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(rate * F.col("tokens") * F.col("n")).alias("g"), F.sum(free * F.col("tokens") * x * F.col("n")).alias("h"))
        for r in sums.collect():
            s, miss = r["source"], r["g"] - goal[r["source"]]
            if abs(miss) <= tolerance * goal[s]:
                open_.discard(s)
                continue
            (hi if miss > 0 else lo)[s] = lam[s]
            nxt = lam[s] - miss / r["h"] if r["h"] > 0 else math.nan
            if not lo[s] < nxt < hi[s]:
                if math.isinf(lo[s]):
                    nxt = hi[s] - max(1.0, abs(hi[s]))
                elif math.isinf(hi[s]):
                    nxt = lo[s] + max(1.0, abs(lo[s]))
                else:
                    nxt = (lo[s] + hi[s]) / 2
            if hi[s] - lo[s] < 1e-13:
                open_.discard(s)
            lam[s] = nxt
    return lam


def mix_sources(sized: DataFrame, targets: DataFrame, key: str, source: str, size: str, total: float | None = None, seed: int = 0) -> DataFrame:
    """(key, source, tokens, rate, copies) for every document of a target source; copies may be 0.

    `total` is the size of the mix in tokens; by default the largest in which all sources that hold
    tokens reach their share within max_repeats. A larger total leaves short sources at their cap,
    which mix_report shows. Documents of no target source, or without tokens, get no row or 0 copies.
    `targets` has one line per source, read by the driver; spelling of sources is compared by id_key.
    """
    spark = sized.sparkSession
    t = {r["s"]: (float(r["share"]), int(r["cap"])) for r in targets.select(id_key(F.col("source")).alias("s"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("s IS NOT NULL AND share IS NOT NULL AND cap IS NOT NULL").collect()}
    lines = spark.createDataFrame(sorted((s, c) for s, (_, c) in t.items()), "__s string, __cap int")
    d = sized.withColumn("__s", id_key(F.col(source))).join(F.broadcast(lines), "__s").select(F.col(key), F.col("__s").alias("source"), F.col(size).cast("bigint").alias("tokens"))
    d = cut(d)
    hist = cut(d.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: (int(r["t"]), r["t"] / r["n"]) for r in hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    held = {s: v[0] for s, v in have.items()}
    size_of = feasible_total(held, t) if total is None else float(total)
    whole = sum(t[s][0] for s in have) or 1.0
    goal = {s: float(min(size_of * t[s][0] / whole, held[s] * t[s][1])) for s in have}
    lam = solve_rates(hist, have, goal, {s: t[s][1] for s in have})
    rows = [(s, max(min(lam[s], 1e300), -1e300), float(have[s][1]), float(t[s][1]), goal[s]) for s in sorted(have)]
    per = spark.createDataFrame(rows, "source string, lam double, mean double, cap double, goal double")
    expo = F.col("lam") * F.col("tokens") / F.col("mean")
    rate = F.when(F.col("tokens") <= 0, 0.0).otherwise(F.least(F.col("cap"), F.exp(F.greatest(F.least(expo, F.lit(700.0)), F.lit(-700.0)))))
    d = d.join(F.broadcast(per), "source", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    d = d.withColumn("__h", hash_order(seed, F.col(key)))
    # along length classes (quarters of an octave) and random inside them
    level = F.floor(F.log2(F.greatest(F.col("tokens"), F.lit(1))) * 4).cast("int") * 4096 + F.shiftrightunsigned("__h", 51).cast("int")
    d = running_total(d, ["source"], "__h", F.col("rate"), "__sum", tie=[key], slice_of=level)
    # one random start per source; the small shift keeps sums that are whole from falling short
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1_000_003)) / 1_000_003.0 * F.lit(0.998) + F.lit(0.001)
    eps = F.lit(1e-7)
    whole_rate = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    copies = F.when(whole_rate, F.round("rate")).otherwise(F.floor(F.col("__sum") + start + eps) - F.floor(F.col("__sum") - F.col("rate") + start + eps))
    return d.select(key, "source", "tokens", "rate", F.least(copies, F.ceil(F.col("cap"))).cast("int").alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens and documents there, tokens taken, the share reached beside the target."""
    m = mixed.groupBy(F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("tokens_there"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_taken"), F.max("copies").alias("most_copies"))
    total = m.agg(F.sum("tokens_taken").alias("all_taken"))  # a single row
    d = targets.join(m, id_key(targets["source"]) == F.col("__s"), "left").crossJoin(total)
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("source", "target_share", "max_repeats", z("n_documents"), z("tokens_there"), z("tokens_taken"), z("most_copies"), (F.coalesce("tokens_taken", F.lit(0)) / F.col("all_taken")).alias("share"))
