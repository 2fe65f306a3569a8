"""Curation of text records: overlap with references, duplicates, splits and quotas, orders, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import text as X
from lodestat.operators import grams as G
from lodestat.operators.ordering import group_rank, running_totals, value_slices
from lodestat.operators.skew import salted_join
from lodestat.session import cut, spread


def ngram_overlap(docs: DataFrame, refs: DataFrame, key: str, text: str, ref_key: str, ref_text: str, n: int = 8) -> DataFrame:
    """(key, n_grams, union_ratio, best_ratio): share of a document's distinct word n-grams found in the
    union of the references and in the single best reference; keys of both are unique. N-grams are compared as digests of
    16 bytes; documents with fewer than n words have ratio 0.

    Documents keep only those n-grams that a bitmap of the references' lets pass, and references those that one of these
    lets pass. Documents, and references, with the same set left form a class; classes meet in blocks, so that no pair of
    a document and a reference and no n-gram that is not shared goes through a shuffle."""
    r = spread(refs.select(ref_key, ref_text)).select(F.col(ref_key).alias("__ref"), F.col(ref_text).alias("__text"))
    d = spread(docs.select(key, F.col(text).alias("__text")))
    held = cut(G.digest_sets(d, key, "__text", n, G.bitmap_of_texts(r.select("__text"), n)).withColumn("cls", F.when(F.length("hits") > 0, F.unhex(F.md5("hits")))))
    some = held.where("cls IS NOT NULL")
    sets = cut(some.groupBy("cls", "hits").agg(F.count(F.lit(1)).alias("n")))
    others = cut(G.digest_sets(r, "__ref", "__text", n, G.bitmap_of_sets(sets.select("hits"))).where(F.length("hits") > 0).select("hits").distinct())
    one = lambda df, *more: df.select(*more, F.explode(G.members("hits")).alias("gram"))
    union = salted_join(one(sets, "cls"), one(others).distinct(), ["gram"], F.col("cls"), "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("any"))
    per = cut(union.join(G.most_shared(sets.select("cls", "hits"), others), "cls", "left"))
    j = salted_join(some.drop("hits"), per, ["cls"], F.col(key), "left", counts=sets.select("cls", "n"))
    none = held.where("cls IS NULL").select(key, "n_grams", F.lit(0).cast("bigint").alias("any"), F.lit(0).cast("bigint").alias("best"))
    j = j.select(key, "n_grams", "any", "best").unionByName(none)
    ratio = lambda c: F.when(F.col("n_grams") > 0, F.coalesce(c, F.lit(0)) / F.col("n_grams")).otherwise(0.0)
    return j.select(key, "n_grams", ratio(F.col("any")).alias("union_ratio"), ratio(F.col("best")).alias("best_ratio"))


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kept_key): the smallest key of all documents with the same normalised text. First the minimum per
    digest, then a join in which digests of many copies are spread over slots."""
    d = cut(docs.select(key, F.unhex(F.sha2(X.normalize_text(F.col(text)), 256)).alias("h")))
    least = d.groupBy("h").agg(F.min(key).alias("kept_key"), F.count(F.lit(1)).alias("n"))
    return salted_join(d, least.drop("n"), ["h"], F.col(key), counts=least.select("h", "n")).select(key, "kept_key")


def hash_split(ids: Column, seed: int, parts: Sequence[tuple[str, int]]) -> Column:
    """A split by the digest of seed and id modulo 100; parts in percent."""
    bucket = X.hash_unit(str(seed), ids.cast("string")) % 100
    out, upto = None, 0
    for name, share in parts:
        upto += share
        cond = bucket < upto
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def quotas(total: int, parts: Sequence[tuple[str, int]]) -> dict[str, int]:
    """Rest to the first part; the others at least one and rounded up."""
    rest = {n: max(1, -(-total * p // 100)) for n, p in parts[1:]}
    return {parts[0][0]: total - sum(rest.values())} | rest


def digest_order(seed: int, *cols: Column | str) -> Column:
    """A stable order key from the digest of seed and columns (joined by colons): 60 bits, as a non-negative
    63-bit number, so that running totals can slice it. The same anywhere sha256 is."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in parts])
    return F.shiftleft(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint"), 3)


def split_quota(df: DataFrame, groups: Sequence[str], key: str, split: str, quota: dict[str, int], seed: int = 0) -> DataFrame:
    """The first rows of each group and split by digest order, up to the split's quota."""
    d = group_rank(df.withColumn("__h", digest_order(seed, key)), [*groups, split], "__h", "position", tie=[key])
    limit = F.lit(None).cast("int")
    for name, n in quota.items():
        limit = F.when(F.col(split) == name, n).otherwise(limit)
    return d.where(F.col("position") <= limit).drop("__h")


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a digest of seed and key; a top-n, not a sort of the table."""
    return df.withColumn("order_hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("order_hash", key).limit(n)


def digest_sorted(df: DataFrame, seed: int, cols: Sequence[str], tie: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the order of a digest of seed and columns, with their place: the order of a final mix,
    read from its front."""
    d = df.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)).orderBy("__h", *tie).limit(n)
    return d.withColumn("place", F.row_number().over(Window.orderBy("__h", *tie))).drop("__h")


def allocate_disjoint(ids: DataFrame, used: DataFrame, key: str, parts: Sequence[tuple[str, int]], seed: int) -> DataFrame:
    """(key, part, place): ids not used yet, in digest order, the first count to the first part and so on."""
    d = digest_sorted(ids.join(used, key, "left_anti"), seed, [key], [key], sum(n for _, n in parts))
    part, upto = F.lit(None).cast("string"), sum(n for _, n in parts)
    for name, n in reversed(parts):
        part = F.when(F.col("place") <= upto, name).otherwise(part)
        upto -= n
    return d.select(key, part.alias("part"), "place")


def tiered(df: DataFrame, tier: str, key: str, seed: int) -> DataFrame:
    """Adds `place`: higher tiers first, digest order inside. Tiers are few; inside them ranks go over slices."""
    d = group_rank(df.withColumn("__h", digest_order(seed, key)), [tier], "__h", "__r", tie=[key])
    n = df.groupBy(F.col(tier).alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("__t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__b"))
    return d.join(base, F.col(tier) == F.col("__t")).withColumn("place", F.col("__b") + F.col("__r")).drop("__h", "__r", "__t", "__b")


def interleaved(df: DataFrame, fresh: Column, key: str, every: int, seed: int) -> DataFrame:
    """(key, fresh, place): `every` fresh rows, one other, and so on, each kind in digest order; when one kind is used
    up the other goes on alone. Places are counted, not sorted: a row's place is its rank plus how many of the
    other kind come before it."""
    d = group_rank(df.select(key, fresh.alias("fresh")).withColumn("__h", digest_order(seed, key)), ["fresh"], "__h", "__r", tie=[key])
    n = df.agg(F.count(F.when(fresh, 1)).alias("__f"), F.count(F.when(~fresh, 1)).alias("__o"))
    d = d.crossJoin(F.broadcast(n))
    before = F.when(F.col("fresh"), F.least(F.floor((F.col("__r") - 1) / every), F.col("__o"))).otherwise(F.least(F.col("__r") * every, F.col("__f")))
    return d.select(key, "fresh", (F.col("__r") + before).cast("bigint").alias("place"))


def compensation(own: DataFrame, other: DataFrame, category: str, tokens: str, ratio: float, shares: Mapping[str, float]) -> DataFrame:
    """Per category (wanted, available, scale, budget): what `own` has to give so that it makes up `ratio` of all tokens
    with the categories in the given shares. Deficits are scaled by one factor, at most 1, that the scarcest
    category allows. One line per category."""
    want = other.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{category} string, __share double")
    total = other.agg(F.round(F.coalesce(F.sum(tokens), F.lit(0)) / (1.0 - ratio)).alias("__total"))
    there = other.groupBy(category).agg(F.sum(tokens).alias("__there"))
    have = own.groupBy(category).agg(F.sum(tokens).alias("__have"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = want.crossJoin(total).join(there, category, "left").join(have, category, "left")
    d = d.withColumns({"wanted": F.greatest(F.lit(0), F.round(F.col("__total") * F.col("__share")) - zero("__there")).cast("bigint"), "available": zero("__have").cast("bigint")})
    scale = F.least(F.lit(1.0), F.min(F.when(F.col("wanted") > 0, F.col("available") / F.col("wanted"))).over(Window.partitionBy(F.lit(1))))
    d = d.withColumn("__scale", scale)
    return d.select(category, "wanted", "available", F.round("__scale", 6).alias("scale"), F.round(F.col("wanted") * F.col("__scale")).cast("bigint").alias("budget"))


def least_budget(df: DataFrame, slice_: str, by: Sequence[str], tokens: str) -> DataFrame:
    """Per group the smallest total over all slices (0 where a slice has nothing there), and how many slices it has."""
    per = df.groupBy(*by, slice_).agg(F.sum(tokens).alias("n"))
    k = df.agg(F.countDistinct(slice_).alias("__k"))
    g = per.groupBy(*by).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n_slices"))
    return g.crossJoin(k).select(*by, F.when(F.col("n_slices") == F.col("__k"), F.col("least")).otherwise(0).cast("bigint").alias("budget"), "n_slices")


def round_robin(df: DataFrame, strata: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """Adds the turn of each row in its stratum: turn 1 of all strata first, then turn 2, and so on."""
    d = df.withColumn("__h", digest_order(seed, key))
    return group_rank(d, strata, "__h", "turn", tie=[key]).drop("__h")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, n): floors of the shares, the rest to the largest remainders (ties by key). One row per category."""
    w = weights.groupBy(key).agg(F.sum(weight).alias("w"))
    t = w.agg(F.sum("w").alias("t"))
    d = w.crossJoin(t).withColumn("exact", F.col("w") / F.col("t") * total).withColumn("lo", F.floor("exact"))
    spare = F.lit(total) - F.sum("lo").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("lo"), 12)), key))
    return d.withColumn("spare", spare).withColumn("rank", rank).select(key, (F.col("lo") + (F.col("rank") <= F.col("spare")).cast("int")).alias("n"))


def token_ratios(df: DataFrame, by: Sequence[str], tokens: str) -> DataFrame:
    """Tokens and share per grouping set (each column alone) and in total."""
    sets = df.groupingSets([[], *[[c] for c in by]], *by).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("level"))
    total = df.agg(F.sum(tokens).alias("__all"))
    return sets.crossJoin(total).select("level", *by, "n_rows", "tokens", F.round(F.col("tokens") / F.col("__all"), 4).alias("ratio"))


def budget_trim(df: DataFrame, groups: Sequence[str], key: str, tokens: str, budget: int, repeats: int = 1, seed: int = 0, pool: int = 10_000) -> DataFrame:
    """Greedy per group: in digest order a row is kept if it fits the budget left, skipped otherwise;
    the first row always stays. With repeats further passes follow over all rows, numbered.

    A sequential rule in rounds. A round takes, by running totals over slices, the rows in order that fit as a
    whole; the next `pool` rows of a group behind these go through one task; of what follows only rows
    not larger than the budget left go on. So a task holds `pool` rows of a group, whatever its size."""
    d = df.select(*groups, key, F.col(tokens).cast("bigint").alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))
    d = d.withColumn("__h", digest_order(seed, key)).withColumn("__slice", F.floor(F.col("__h") / 2**53).cast("int") + F.col("repeat_index") * 1024)
    kept = None
    cols = [*groups, key, "repeat_index", F.col("__n").alias("tokens")]
    same = lambda a, b: _all_equal(a, b, groups)
    rest = d.withColumn("__left", F.lit(budget).cast("bigint")).withColumn("__first", F.lit(True))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["repeat_index", "__h", key])
        left, keep = int(pdf["__room"].iloc[0]), []
        for n in pdf["__n"]:
            keep.append(n <= left)
            left -= n if n <= left else 0
        pdf["__keep"] = keep
        return pdf[[*groups, key, "repeat_index", "__n", "__keep"]]

    while True:
        run = running_totals(rest, groups, "__h", {"__upto": F.col("__n"), "__rank": F.lit(1).cast("bigint")}, tie=["repeat_index", key], slice_of=F.col("__slice"))
        run = cut(run.withColumn("__whole", (F.col("__upto") <= F.col("__left")) | (F.col("__first") & (F.col("__rank") == 1))))
        state = run.groupBy(*groups).agg(F.first("__left").alias("__had"), F.coalesce(F.sum(F.when(F.col("__whole"), F.col("__n"))), F.lit(0)).alias("__took"), F.count(F.when(F.col("__whole"), 1)).alias("__upto_rank"))
        state = state.select(*[F.col(g).alias(f"__g_{g}") for g in groups], (F.col("__had") - F.col("__took")).alias("__room"), "__upto_rank")
        behind = run.where("NOT __whole").join(state, same(run, state)).drop(*[f"__g_{g}" for g in groups])
        now = behind.where((F.col("__rank") <= F.col("__upto_rank") + pool) & (F.col("__n") <= F.col("__room")))
        judged = cut(now.groupBy(*groups).applyInPandas(greedy, run.select(*groups, key, "repeat_index", "__n").withColumn("__keep", F.lit(True)).schema))
        new = run.where("__whole").select(*cols).unionByName(judged.where("__keep").select(*cols))
        kept = new if kept is None else kept.unionByName(new)
        used = judged.groupBy(*groups).agg(F.coalesce(F.sum(F.when(F.col("__keep"), F.col("__n"))), F.lit(0)).alias("__used")).select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__used")
        later = behind.where(F.col("__rank") > F.col("__upto_rank") + pool)
        later = later.join(used, same(later, used), "left").drop(*[f"__g_{g}" for g in groups]).withColumn("__left", F.col("__room") - F.coalesce("__used", F.lit(0)))
        rest = cut(later.where(F.col("__n") <= F.col("__left")).select(*groups, key, "__n", "repeat_index", "__h", "__slice", "__left").withColumn("__first", F.lit(False)))
        if rest.isEmpty():
            return kept


def _all_equal(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & a[g].eqNullSafe(b[f"__g_{g}"])
    return out


def chat_errors(messages: Column, metadata: Column, required: Sequence[str]) -> Column:
    """What is wrong with a chat record: an array of messages, empty if nothing is."""
    roles = F.transform(messages, lambda m: m["role"])
    blank = F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")
    known = F.forall(roles, lambda r: F.coalesce(r.isin("system", "user", "assistant", "tool"), F.lit(False)))
    said = F.filter(roles, lambda r: r != "system")
    checks = [
        (messages.isNull() | (F.size(messages) < 2), "fewer than two messages"),
        (F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")) != "user", "first message is not the user's"),
        (F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")) != "assistant", "last message is not the assistant's"),
        (~known, "unknown role"),
        (blank, "empty content"),
        *[(metadata[m].isNull(), f"missing {m}") for m in required],
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def rank_scores(df: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """Replaces a score by 1 - (rank - 1) / (rows - 1) in its group, by (score descending, key); ranks go over
    slices of the score, so no group is sorted in one task. Null scores rank last."""
    worst = F.coalesce(-F.when(~F.isnan(score), F.col(score)), F.lit(float("inf")))
    d, at = value_slices(df.withColumn("__worst", worst), "__worst")
    d = running_totals(d, [group], "__worst", {"__rank": F.lit(1).cast("bigint")}, tie=[key], slice_of=at, whole={"__rank": "__rows"})
    return d.withColumn(score, F.when(F.col("__rows") > 1, 1 - (F.col("__rank") - 1) / (F.col("__rows") - 1)).otherwise(1.0)).select(*df.columns)


def mmr(df: DataFrame, group: str, key: str, text: str, score: str, k: int, penalty: float = 0.35, n: int = 3, pool: int = 400) -> DataFrame:
    """Maximal marginal relevance per group: next is the row with the largest relevance minus penalty times
    its largest Jaccard similarity to those chosen (ties: larger key; keys are unique in a group). The
    relevance of a row is 1 - (rank - 1) / (rows - 1) by (score descending, key), 1 in a group of one row.

    Exact over all rows, while one task holds only `pool` of a group: those with the largest value against
    what is chosen already. A pick stands if its value is above that of the best row left out, which can
    only fall; from the first pick that isn't, the next round values all rows of that group anew. The first
    pick of a round always stands, so there are at most k rounds."""
    if penalty < 0 or pool < 1:
        raise ValueError("penalty must not be negative, pool must be positive")
    kinds = dict(df.dtypes)
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, position int, mmr double, grams array<string>, more boolean"
    d = rank_scores(df.select(group, key, F.col(text).alias("__t"), F.col(score).cast("double").alias("score")), group, key, "score")
    w = Window.partitionBy(group).orderBy(F.desc("value"), F.desc(key))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        rest = (pdf["value"].iloc[pool], pdf[key].iloc[pool]) if len(pdf) > pool else None
        name, had, pdf = pdf[group].iloc[0], int(pdf["had"].iloc[0]), pdf.iloc[:pool]
        sets = [frozenset(g) for g in pdf["grams"]]
        near, left, out = pdf["near"].tolist(), set(range(len(sets))), []
        keys, scores = pdf[key].tolist(), pdf["score"].tolist()
        while left and had + len(out) < k:
            i = max(left, key=lambda i: (scores[i] - penalty * near[i], keys[i]))
            value = scores[i] - penalty * near[i]
            if rest and out and (value, keys[i]) <= rest:
                break
            left.discard(i)
            out.append((name, keys[i], had + len(out) + 1, value, list(sets[i])))
            for j in left:
                u = len(sets[i] | sets[j])
                near[j] = max(near[j], len(sets[i] & sets[j]) / u if u else 0.0)
        more = rest is not None and had + len(out) < k
        return pd.DataFrame([(*o, more) for o in out], columns=[group, key, "position", "mmr", "grams", "more"])

    name_of = F.when(F.col(group).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    left, picked = d.withColumn("near", F.lit(0.0)).withColumn("had", F.lit(0)), None
    while True:
        pooled = left.withColumn("value", F.col("score") - F.lit(float(penalty)) * F.col("near")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool + 1)
        pooled = pooled.withColumn("grams", X.word_ngrams(F.col("__t"), n)).drop("__t")  # of the pool only
        made = cut(pooled.groupBy(group).applyInPandas(choose, schema))
        picked = made if picked is None else picked.unionByName(made)
        if made.where("more").isEmpty():
            return picked.select(group, key, "position", "mmr")
        unfinished = made.where("more").select(name_of.alias("__g")).distinct()
        known = picked.withColumn("__g", name_of).join(unfinished, "__g").groupBy("__g").agg(F.collect_list(key).alias("__keys"), F.collect_list("grams").alias("__sets"), F.count(F.lit(1)).cast("int").alias("had"))
        nearest = F.aggregate("__sets", F.lit(0.0), lambda m, g: F.greatest(m, X.jaccard(F.col("grams"), g)))
        rest = salted_join(d.withColumn("__g", name_of), known, ["__g"], F.col(key)).where(~F.array_contains("__keys", F.col(key))).withColumn("grams", X.word_ngrams(F.col("__t"), n))
        left = rest.withColumn("near", nearest).drop("__g", "__keys", "__sets", "grams")


def selected_tokens(deltas: Column, offset: int, share: float, floor: float, last: int = 2) -> Column:
    """Positions of the tokens with the largest gains above a floor, the last ones always included."""
    at = F.transform(deltas, lambda x, i: F.struct((-x).alias("d"), i.alias("i")))
    good = F.array_sort(F.filter(at, lambda s: -s["d"] > floor))
    top = F.transform(F.slice(good, 1, F.greatest(F.ceil(F.size(good) * share).cast("int"), F.lit(0))), lambda s: s["i"])
    tail = F.when(F.size(deltas) > 0, F.sequence(F.greatest(F.size(deltas) - last, F.lit(0)), F.size(deltas) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.transform(F.array_union(top, tail), lambda i: i + offset - 1))
