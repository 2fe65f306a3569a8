"""Preparing records: verified answers, lookups with reasons, scripts and languages, scoring of answers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import text as X
from lodestat.functions.dist import norm_ppf
from lodestat.operators import router as R
from lodestat.operators.curate import digest_order
from lodestat.operators.ordering import group_rank
from lodestat.operators.preprocess import AnalysisError


def verified_answer(generations: Column, correct: Column, complete: Column, finish: Column, canonical: Column) -> Column:
    """The shortest (the first of equals) of the trimmed generations marked correct and complete that ended by themselves
    (`stop`, `eos`, or no reason listed), and of the canonical solution if there is one besides them; null
    without any verified generation. Marks shorter than the list count as missing."""
    at = lambda a, i: F.try_element_at(a, i + 1)
    done = lambda i: (i >= F.coalesce(F.size(finish), F.lit(0))) | F.coalesce(at(finish, i).isin("stop", "eos"), F.lit(False))
    good = lambda g, i: g.isNotNull() & F.coalesce(at(correct, i), F.lit(False)) & F.coalesce(at(complete, i), F.lit(False)) & done(i)
    kept = F.transform(F.filter(generations, good), lambda g: F.trim(g))
    own = F.filter(F.array(F.trim(canonical)), lambda c: F.coalesce(c, F.lit("")) != "")
    ranked = F.transform(F.concat(kept, own), lambda g, i: F.struct(F.length(g).alias("n"), i.alias("i"), g.alias("g")))
    return F.when(F.size(kept) > 0, F.array_min(ranked)["g"])


def pinned(scores: DataFrame, records: DataFrame, keys: Sequence[str], pins: Mapping[str, str], hash_: str) -> DataFrame:
    """Scores made by the pinned model and revision of the very record: equal keys and equal digest of its content."""
    d = scores
    for c, v in pins.items():
        d = d.where(F.col(c) == v)
    return d.join(records.select(*keys, hash_).distinct(), [*keys, hash_], "left_semi")


def matched(tables: Sequence[DataFrame], keys: Sequence[str], hash_: str) -> DataFrame:
    """Inner join of tables on keys and content digest: rows whose content changed between stages fall out."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, [*keys, hash_])
    return out


def with_parent(rows: DataFrame, parents: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows beside their parent by key, with `reason`: missing_parent, the first check that fails, or null. The parents'
    keys are unique; a null key has no parent."""
    j = rows.join(parents.withColumn("__there", F.lit(True)), key, "left")
    reason = F.when(F.col("__there").isNull(), "missing_parent")
    for name, ok in checks:
        reason = reason.when(~F.coalesce(ok, F.lit(False)), name)
    return j.withColumn("reason", reason).drop("__there")


def candidate_outcome(picks: DataFrame, candidates: DataFrame, keys: Sequence[str], method: str, regret: str, valid: str, clarify: str = "needs_clarification") -> DataFrame:
    """The regret and validity of the chosen candidate; a request for clarification, or a method that is no candidate,
    has regret 1 and is invalid."""
    j = picks.join(candidates.select(*keys, method, F.col(regret).alias("__r"), F.col(valid).alias("__v")), [*keys, method], "left")
    known = F.col("__r").isNotNull() & (F.col(method) != clarify)
    return j.withColumns({regret: F.when(known, F.col("__r")).otherwise(1.0), valid: F.when(known, F.col("__v")).otherwise(False)}).drop("__r", "__v")


@cache
def variant_letters() -> tuple[str, str]:
    """Characters only the traditional, and only the simplified national set has."""
    def held(c: str, enc: str) -> bool:
        try:
            c.encode(enc)
        except UnicodeEncodeError:
            return False
        return True

    letters = [chr(n) for n in range(0x4E00, 0xA000)]
    sides = [(c, held(c, "big5"), held(c, "gb2312")) for c in letters]
    return "".join(c for c, t, s in sides if t and not s), "".join(c for c, t, s in sides if s and not t)


def has_script(c: Column, language: Column, least: int = 8) -> Column:
    """At least eight Han characters and, for zh_Hant or zh_Hans, one that only this script has."""
    hant, hans = variant_letters()
    han = F.regexp_count(c, F.lit("[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]")) >= least
    code = F.lower(F.translate(language, "-", "_"))
    own = F.when(code == "zh_hant", c.rlike(f"[{hant}]")).when(code == "zh_hans", c.rlike(f"[{hans}]")).otherwise(True)
    return F.coalesce(han & own, F.lit(False))


def prose(c: Column) -> Column:
    """A text without code, mathematics, addresses and signs."""
    for p in (*X.PROTECTED, r"https?://\S+", r"[^\p{L}\p{M}\s]"):
        c = F.regexp_replace(c, p, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def language_rows(df: DataFrame, labelled: DataFrame, key: str, text: str, label: str, language: str, short: int = 24) -> DataFrame:
    """(key, kept): rows in a language: prose under `short` characters by its share of ASCII letters (95 %, for en only),
    longer one by naive Bayes over character n-grams fitted on labelled rows. Null texts are not kept."""
    d = df.where(F.col(text).isNotNull()).select(key, prose(F.col(text)).alias("__p"))
    model = R.fit(labelled.where(F.col(text).isNotNull()).select(label, prose(F.col(text)).alias("__p")), key, "__p", label)
    long_ = R.score(d.where(F.length("__p") >= short), model, key, "__p").select(key, (F.col("predicted") == language).alias("kept"))
    ascii_ = F.length(F.regexp_replace("__p", "[^A-Za-z]", "")) / F.greatest(F.length(F.regexp_replace("__p", r"\s", "")), F.lit(1))
    return long_.unionByName(d.where(F.length("__p") < short).select(key, (F.lit(language == "en") & (ascii_ >= 0.95)).alias("kept")))


#: Words that show a rewriting talks about itself.
META = ["edited for", "the text", "original text", "wording", "preserv", "adjusted", "revised", "调整", "修改", "原文", "保留", "要求", "编辑", "措辞", "調整", "編輯", "措辭"]


def refinement_valid(template: Column, candidate: Column, method: Column, longer: int = 80, least: int = 40) -> Column:
    """The rewriting names the method, is neither short nor much longer, doesn't talk about itself and keeps all numbers."""
    quiet = ~F.lower(candidate).rlike("|".join(META))
    size = F.length(candidate).between(F.lit(least), F.length(template) + longer)
    return F.coalesce(candidate.contains(method) & size & quiet & (F.size(F.array_except(X.numbers(template), X.numbers(candidate))) == 0), F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets of normalised strings."""
    form = lambda v: F.array_sort(F.array_distinct(F.transform(v, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))))
    return form(a) == form(b)


def set_scores(df: DataFrame, by: Sequence[str], wanted: str, given: str, method_wanted: str, method_given: str) -> DataFrame:
    """Per group: share of answers with the right method, with the right set of columns, with both, and mean recall of the
    wanted columns."""
    cols, meth = F.coalesce(same_set(F.col(wanted), F.col(given)), F.lit(False)), F.coalesce(F.col(method_wanted) == F.col(method_given), F.lit(False))
    hits = F.size(F.array_intersect(wanted, given)) / F.greatest(F.size(F.array_distinct(wanted)), F.lit(1))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(meth).alias("method_accuracy"), rate(cols).alias("column_accuracy"), rate(cols & meth).alias("exact"), rate(F.coalesce(hits, F.lit(0.0))).alias("recall"))


@F.pandas_udf(T.DoubleType())
def _z_of(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or v != v else -norm_ppf(min(max(v, 1e-300), 1.0) / 2))


def p_value_scores(df: DataFrame, by: Sequence[str], wanted: str, given: str, alpha: float = 0.05, strict: float = 0.5) -> DataFrame:
    """Per group: share of p values on the right side of alpha (raw), and of those whose z is less than `strict` off."""
    raw = F.coalesce((F.col(wanted) < alpha) == (F.col(given) < alpha), F.lit(False))
    close = F.coalesce(F.abs(_z_of(F.col(wanted)) - _z_of(F.col(given))) < strict, F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(raw).alias("raw"), rate(close).alias("strict"))


def _p_values(node: object, label: str) -> Iterator[tuple[str, float]]:
    if isinstance(node, dict):
        named = str(node.get("term") or node.get("name") or label)
        for k, v in node.items():
            if k.lower().replace("-", "_") in ("p_value", "pvalue", "p") and isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
                yield named, float(v)
            else:
                yield from _p_values(v, str(k) if isinstance(v, (dict, list)) else named)
    elif isinstance(node, list):
        for v in node:
            yield from _p_values(v, label)


def find_p_value(text: str | None, target: str | None) -> float | None:
    """Depth first through a result: the p value whose term holds the target's letters, else the only one that is not of
    the intercept; null if neither is there or the text is no JSON."""
    if not text:
        return None
    try:
        found = list(_p_values(json.loads(text), ""))
    except ValueError:
        return None
    form = lambda s: "".join(c for c in s.casefold() if c.isalnum())
    want = form(target or "")
    for name, p in found:
        if want and want in form(name):
            return p
    rest = [p for name, p in found if form(name) not in ("const", "intercept")]
    return rest[0] if len(rest) == 1 else None


def p_values_found(df: DataFrame, key: str, result: str, target: str) -> DataFrame:
    """(key, p_value) of each row's nested result; null where none can be told."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [find_p_value(t, v) for t, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], [key, "p_value"])

    return df.select(key, result, target).mapInArrow(run, f"{key} {kind}, p_value double")


def target_errors(ids: Column, probabilities: Column, regrets: Column, selected: Column, most: int = 6, tolerance: float = 1e-7) -> Column:
    """What is wrong with a record of soft targets: an array of messages, empty if nothing is."""
    n = F.coalesce(F.size(ids), F.lit(0))
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    checks = [
        (n <= 0, "no candidates"),
        (n > most, "too many candidates"),
        (F.size(F.array_distinct(ids)) < n, "repeated candidate"),
        ((F.size(probabilities) != n) | (F.size(regrets) != n), "lists of unequal length"),
        (F.exists(probabilities, lambda x: x.isNull() | (x < 0) | (x > 1)), "probability outside 0 and 1"),
        (F.coalesce(F.abs(total - 1) > tolerance, F.lit(True)), "probabilities do not sum to one"),
        (~F.coalesce(F.array_contains(ids, selected), F.lit(False)), "selected is no candidate"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for c, t in checks]))


def complete_only(df: DataFrame, tokens: str, limit: int, split: str) -> DataFrame:
    """Rows within the limit, none cut; a split that would be left empty is an error."""
    kept = df.where(F.col(tokens) <= limit)
    empty = df.select(split).distinct().join(kept.select(split).distinct(), split, "left_anti").where(F.col(split).isNotNull())
    names = sorted(str(r[0]) for r in empty.limit(10).collect())
    if names:
        raise AnalysisError(f"no record of {', '.join(names)} is within {limit}")
    return kept


def requirements_met(done: DataFrame, wanted: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """(keys, wanted number, done, met): successes per bucket against the number asked for."""
    have = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"))
    return wanted.join(have, list(keys), "left").select(*keys, n, F.coalesce("done", F.lit(0)).alias("done"), (F.coalesce("done", F.lit(0)) >= F.col(n)).alias("met"))


def stratified_halves(df: DataFrame, category: str, hard: Column, key: str, each: int, seed: int) -> DataFrame:
    """Per category `each` easy and `each` hard rows in digest order, with `half` and `place`."""
    d = df.withColumn("half", F.when(F.coalesce(hard, F.lit(False)), "hard").otherwise("easy")).withColumn("__h", digest_order(seed, key))
    return group_rank(d, [category, "half"], "__h", "place", tie=[key]).where(F.col("place") <= each).drop("__h")


def balanced_counts(total: int, shares: Mapping[str, float], members: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Rows per member: shares of the total rounded to even, the last share takes the rest; inside a share equally, one more
    to the first members."""
    left, out = total, {}
    names = list(shares)
    for i, name in enumerate(names):
        n = left if i == len(names) - 1 else round(total * shares[name])
        left -= n
        each, more = divmod(n, len(members[name]))
        out |= {m: each + (j < more) for j, m in enumerate(members[name])}
    return out


def early_stops(history: DataFrame, by: Sequence[str], step: str, value: str, patience: int, least_gain: float = 0.0) -> DataFrame:
    """(by, best_step, best, stop_step): the first step with the least value so far, and the first step that is `patience`
    steps behind the last gain, null if there is none. Runs are short: steps of one run meet in one task."""
    w = Window.partitionBy(*by).orderBy(step)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = history.withColumn("__gain", before.isNull() | (F.col(value) < before - least_gain)).withColumn("__no", F.row_number().over(w))
    d = d.withColumn("__last", F.max(F.when(F.col("__gain"), F.col("__no"))).over(w))
    best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
    return d.groupBy(*by).agg(best.alias("b"), F.min(F.when(F.col("__no") - F.col("__last") >= patience, F.col(step))).alias("stop_step")).select(*by, F.col("b.s").alias("best_step"), F.col("b.v").alias("best"), "stop_step")
