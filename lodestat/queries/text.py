"""Text functions, curation, routing and evaluation over the test tables."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.functions import text as X
from lodestat.functions.keys import code_key, id_key
from lodestat.operators import curate as U
from lodestat.operators import evaluate as E
from lodestat.operators import policy as O
from lodestat.operators import records as P
from lodestat.operators import router as R
from lodestat.queries.stats import rounded
from lodestat.session import shared_folder
from lodestat.sources.tables import table

_PARTS = [("train", 90), ("valid", 5), ("test", 5)]


def _docs(s: SparkSession, d: str, *more: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", *more)


def normalized_text(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select("doc_id", X.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def word_ngrams(s: SparkSession, d: str) -> DataFrame:
    g = _docs(s, d).select("doc_id", F.explode(X.word_ngrams(F.col("text"), 3)).alias("gram"))
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_grams"), F.md5(F.array_join(F.array_sort(F.collect_list("gram")), "|")).alias("digest"))


def ngram_document_frequency(s: SparkSession, d: str) -> DataFrame:
    """Top 100 word pairs by document frequency: the report is a top-k."""
    g = _docs(s, d).select("doc_id", F.explode(X.word_ngrams(F.col("text"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 2").orderBy(F.desc("df"), "gram").limit(100)


def ngram_overlap(s: SparkSession, d: str) -> DataFrame:
    """Documents against the canary prompts as references, by four words."""
    refs = table(s, d, "routing_canary").select("canary_row", F.col("text").alias("ref_text"))
    return rounded(U.ngram_overlap(_docs(s, d), refs, "doc_id", "text", "canary_row", "ref_text", 4))


def contamination_flags(s: SparkSession, d: str) -> DataFrame:
    """First user prompts against the canary prompts: eight words, half of them in one reference."""
    u = F.try_element_at(F.filter("messages", lambda x: x["role"] == "user"), F.lit(1))["content"]
    c = table(s, d, "chat_records").select("record_id", u.alias("text"))
    refs = table(s, d, "routing_canary").select("canary_row", F.col("text").alias("ref_text"))
    return U.ngram_overlap(c, refs, "record_id", "text", "canary_row", "ref_text", 8).select("record_id", "n_grams", F.round("best_ratio", 6).alias("best_ratio"), (F.col("best_ratio") >= 0.5).alias("contaminated"))


def exact_dedup(s: SparkSession, d: str) -> DataFrame:
    return U.exact_duplicates(_docs(s, d).where(F.col("text").isNotNull()), "doc_id", "text")


def hash_split(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", U.hash_split(F.col("doc_id"), 42, _PARTS).alias("split"))


def split_counts(s: SparkSession, d: str) -> DataFrame:
    return hash_split(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_quota(s: SparkSession, d: str) -> DataFrame:
    """The feature is the quota: per source and split the first rows in digest order."""
    x = table(s, d, "documents").select("doc_id", id_key(F.col("source")).alias("source"), U.hash_split(F.col("doc_id"), 42, _PARTS).alias("split"))
    return U.split_quota(x, ["source"], "doc_id", "split", U.quotas(50, _PARTS)).select("doc_id", "source", "split", "position")


def stable_sample(s: SparkSession, d: str) -> DataFrame:
    return U.stable_sample(_docs(s, d).select("doc_id"), "doc_id", 100, 7)


def round_robin_strata(s: SparkSession, d: str) -> DataFrame:
    return U.round_robin(table(s, d, "documents").select("doc_id", code_key(F.col("lang")).alias("lang")), ["lang"], "doc_id").select("doc_id", "lang", "turn")


def largest_remainder(s: SparkSession, d: str) -> DataFrame:
    return U.largest_remainder(table(s, d, "documents").select(F.coalesce(code_key(F.col("lang")), F.lit("?")).alias("lang"), F.lit(1).alias("one")), "lang", "one", 97)


def token_ratios(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(code_key(F.col("lang")).alias("lang"), F.col("domain"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return U.token_ratios(x, ["lang", "domain"], "n_chars")


def token_budget_trim(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.coalesce(code_key(F.col("lang")), F.lit("?")).alias("lang"), "n_chars")
    return U.budget_trim(x, ["lang"], "doc_id", "n_chars", 20_000)


def repeat_to_budget(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.coalesce(code_key(F.col("lang")), F.lit("?")).alias("lang"), "n_chars")
    return U.budget_trim(x, ["lang"], "doc_id", "n_chars", 100_000, repeats=3)


def chat_validation(s: SparkSession, d: str) -> DataFrame:
    need = ["source_id", "source_repo", "source_revision", "source_license", "domain", "language"]
    c = table(s, d, "chat_records")
    e = U.chat_errors(F.col("messages"), F.col("metadata"), need)
    return c.select("record_id", F.explode(e).alias("error"))


def message_counts(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chat_records").select("record_id", F.explode("messages").alias("m"))
    return m.groupBy(F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.content")).alias("chars"), F.countDistinct("record_id").alias("n_records"))


def extract_numbers(s: SparkSession, d: str) -> DataFrame:
    n = X.numbers(F.col("text"))
    return _docs(s, d).where(F.col("text").isNotNull()).select("doc_id", F.size(n).alias("n_numbers"), F.md5(F.array_join(n, "|")).alias("digest"))


def code_blocks(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chat_records").select("record_id", F.posexplode("messages").alias("pos", "m")).where("m.role = 'assistant' AND m.content LIKE '%```%'")
    b = X.code_blocks(F.col("m.content"))
    return m.select("record_id", "pos", F.size(b).alias("n_blocks"), F.md5(F.array_join(b, "\n")).alias("digest"))


def preservation(s: SparkSession, d: str) -> DataFrame:
    """First prompt and first answer of each record as source and rendering: what differs in blocks of code, formulas
    and numbers."""
    first = lambda role: F.try_element_at(F.filter("messages", lambda x: x["role"] == role), F.lit(1))["content"]
    c = table(s, d, "chat_records").select("record_id", first("user").alias("a"), first("assistant").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return c.select("record_id", F.array_join(X.preservation_errors(F.col("a"), F.col("b")), "; ").alias("errors"))


def compact_texts(s: SparkSession, d: str) -> DataFrame:
    """First question without label and menu, first answer behind its thoughts and without tags, its longest block, the
    final text of both as sections, and whether the answer gives the method that its tag names."""
    first = lambda role: F.try_element_at(F.filter("messages", lambda x: x["role"] == role), F.lit(1))["content"]
    c = table(s, d, "chat_records").select("record_id", first("user").alias("q"), first("assistant").alias("a"))
    question, said = X.strip_label(X.without_menu(F.col("q"))), X.after_thought(F.col("a"))
    answer = X.without_tags(said, "method", "plan")
    tag = X.tagged(F.col("a"), "method")
    both = X.sections({"Question": question, "Answer": answer})
    return c.select("record_id", F.md5(question).alias("question"), F.md5(answer).alias("answer"), F.length(X.longest_block(said)).alias("block"), F.md5(both).alias("both"), X.answer_matches(F.col("a"), tag).alias("names_method"))


def canary_routes(s: SparkSession, d: str) -> DataFrame:
    """Canary prompts by the three kinds of route."""
    c = table(s, d, "routing_canary").where("text IS NOT NULL")
    t = F.col("text")
    return c.select("canary_row", X.route(t).alias("route"), X.statistics_route(t, F.lit(0)).alias("stats_route"), X.fixed_route(code_key(F.col("family_id")), code_key(F.col("language")), ["survival"], ["zh_hant"]).alias("fixed_route"))


def protected_prompts(s: SparkSession, d: str) -> DataFrame:
    """Chat contents with their code and mathematics behind marks, and whether they come back whole."""
    m = table(s, d, "chat_records").select("record_id", F.posexplode("messages").alias("pos", "m")).select("record_id", "pos", F.col("m.content").alias("t")).where("t IS NOT NULL")
    text, spans = X.protect(F.col("t"), "doc")
    p = m.select("record_id", "pos", "t", text.alias("p"), spans.alias("s"))
    return p.select("record_id", "pos", F.size("s").alias("n_spans"), F.coalesce(X.restored(F.col("p"), F.col("s"), "doc") == F.col("t"), F.lit(False)).alias("whole"))


def token_windows(s: SparkSession, d: str) -> DataFrame:
    """Words of the canary prompts as spans; how many overlap the characters from 10 to 40, and the bucket of the
    prompt's length."""
    c = table(s, d, "routing_canary").where("text IS NOT NULL").select("canary_row", "text", F.split(F.col("text"), " ", -1).alias("w"))
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.length(F.array_join(F.slice(F.col("w"), F.lit(1), i), " ")))
    spans = c.withColumn("e", ends).withColumn("a", F.zip_with("e", "w", lambda e, w: e - F.length(w)))
    hit = X.interval_mask(F.col("a"), F.col("e"), F.lit(10), F.lit(40))
    return spans.select("canary_row", F.size(F.filter(hit, lambda x: x)).alias("n_overlapping"), X.padding_bucket(F.length("text"), [64, 128, 256]).alias("bucket"))


def method_tags(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chat_records").select("record_id", F.posexplode("messages").alias("pos", "m")).where("m.role = 'assistant'")
    t = m.select("record_id", "pos", X.tagged(F.col("m.content"), "method").alias("method"), X.json_object(F.col("m.content")).alias("plan"))
    return t.where("method IS NOT NULL OR plan IS NOT NULL").select("record_id", "pos", "method", F.get_json_object("plan", "$.method_id").alias("planned"))


def _router_parts(s: SparkSession, d: str, **more: Column) -> tuple[DataFrame, DataFrame]:
    """Labelled prompts and the model fitted on the half with an even digest of the text."""
    c = table(s, d, "routing_canary").where("text IS NOT NULL").select("canary_row", "text", F.coalesce(code_key(F.col("family_id")), F.lit("none")).alias("family"), *[c.alias(n) for n, c in more.items()])
    c = c.withColumn("half", F.conv(F.substring(F.sha2("text", 256), 1, 1), 16, 10).cast("int") % 2)
    return c, R.fit(c.where("half = 0"), "canary_row", "text", "family")


def text_router_nb(s: SparkSession, d: str) -> DataFrame:
    c, model = _router_parts(s, d)
    return R.confusion(R.score(c.where("half = 1"), model, "canary_row", "text"), c, "canary_row", "family")


def router_canary(s: SparkSession, d: str) -> DataFrame:
    """Routing of the other half by language, through a model written to and read from the shared folder."""
    c, model = _router_parts(s, d, language=code_key(F.col("language")))
    path = shared_folder(s) + f"/router-{uuid.uuid4().hex}"
    R.save_model(model, path)
    return R.canary_metrics(R.score(c.where("half = 1"), R.load_model(s, path), "canary_row", "text"), c, "canary_row", "family", "language", "none", 0.5)


def text_routes(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", X.route(F.col("text")).alias("route"))


def mmr_select(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text IS NOT NULL AND n_chars > 0").select("doc_id", "text", F.coalesce(code_key(F.col("lang")), F.lit("?")).alias("lang"), (1 / (1 + F.abs(F.col("n_chars") - 400) / 400)).alias("score"))
    return rounded(U.mmr(x, "lang", "doc_id", "text", "score", 20))


def _pred(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "predictions")
    return p.select("prediction_id", "blueprint_id", code_key(F.col("family_id")).alias("family_id"), "domain", code_key(F.col("language")).alias("language"), "adapter_id", "predicted_method_id", "oracle_method_id", "normalized_regret", "valid")


def accuracy_rollup(s: SparkSession, d: str) -> DataFrame:
    return E.accuracy_rollup(_pred(s, d), F.col("predicted_method_id") == F.col("oracle_method_id"), ["domain", "language", "family_id"])


def selector_metrics(s: SparkSession, d: str) -> DataFrame:
    return E.selector_metrics(_pred(s, d), ["domain", "family_id"])


def family_language_metrics(s: SparkSession, d: str) -> DataFrame:
    return E.selector_metrics(_pred(s, d), ["family_id", "language"], cube=True)


def language_macro_mean(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d).where("language IS NOT NULL")
    return E.macro_mean(p, ["family_id"], "language", F.when(~F.isnan("normalized_regret"), F.col("normalized_regret")))


def group_regret(s: SparkSession, d: str) -> DataFrame:
    """By the slug of the adapter."""
    a = table(s, d, "adapters").select("adapter_id", "slug")
    p = _pred(s, d).join(a, "adapter_id").where(~F.isnan("normalized_regret"))
    return p.groupBy("slug", "family_id").agg(F.count("normalized_regret").alias("n"), F.round(F.avg("normalized_regret"), 6).alias("mean_regret"))


def _two_adapters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(s, d, "adapters").select("adapter_id", F.col("parent_adapter_id").isNull().alias("is_parent"))
    p = _pred(s, d).where("language IS NOT NULL AND normalized_regret IS NOT NULL AND NOT isnan(normalized_regret)").join(a, "adapter_id")
    m = p.groupBy("family_id", "language", "is_parent").agg(F.round(F.avg("normalized_regret"), 9).alias("regret"))
    return m.where("is_parent").drop("is_parent"), m.where("NOT is_parent").drop("is_parent")


def noninferiority_gates(s: SparkSession, d: str) -> DataFrame:
    parent, expert = _two_adapters(s, d)
    return rounded(E.non_inferiority(parent, expert, ["family_id", "language"], "regret", 0.01))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d).where("normalized_regret IS NOT NULL AND NOT isnan(normalized_regret)").withColumn("confidence", 1 - F.col("normalized_regret"))
    return E.threshold_sweep(p, "confidence", F.col("predicted_method_id") == F.col("oracle_method_id"), [i / 10 for i in range(1, 10)])


def guard_override(s: SparkSession, d: str) -> DataFrame:
    g = E.guarded(_pred(s, d), F.coalesce(F.col("normalized_regret") > 0.8, F.lit(False)))
    return E.selector_metrics(g, ["domain"])


def paired_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Parent against expert, paired by blueprint and language, averaged per blueprint."""
    a = table(s, d, "adapters").select("adapter_id", F.col("parent_adapter_id").isNull().alias("is_parent"))
    p = _pred(s, d).withColumn("blueprint_id", id_key(F.col("blueprint_id"))).where("blueprint_id IS NOT NULL AND language IS NOT NULL AND normalized_regret IS NOT NULL AND NOT isnan(normalized_regret)").join(a, "adapter_id")
    m = p.groupBy("blueprint_id", "language", "is_parent").agg(F.avg("normalized_regret").alias("regret"))
    x = E.paired(m.where("is_parent"), m.where("NOT is_parent"), ["blueprint_id", "language"], "regret").where("paired")
    return rounded(E.paired_bootstrap(x.groupBy("blueprint_id").agg(F.avg("difference").alias("difference")), "difference", "blueprint_id"))


def best_adapter(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d).where("normalized_regret IS NOT NULL AND NOT isnan(normalized_regret)")
    m = p.groupBy("family_id", "adapter_id").agg(F.round(F.avg("normalized_regret"), 9).alias("regret"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return rounded(E.best_by(m, ["family_id"], [F.col("regret"), F.col("adapter_id")]))


def pairwise_cosine(s: SparkSession, d: str) -> DataFrame:
    return E.pairwise_cosine(table(s, d, "embeddings"), "vec_id", "embedding", "label")


def split_leakage(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "scenarios").select(id_key(F.col("blueprint_id")).alias("b"), id_key(F.col("split")).alias("s"))
    return x.where("s = 'train'").select("b").intersect(x.where("s IN ('valid', 'dev', 'final')").select("b")).withColumnRenamed("b", "blueprint_id")


def _methods(s: SparkSession, d: str) -> DataFrame:
    """Mean regret per family and predicted method: a small policy table."""
    p = _pred(s, d).where("normalized_regret IS NOT NULL AND NOT isnan(normalized_regret) AND predicted_method_id IS NOT NULL")
    return p.groupBy("family_id", "predicted_method_id").agg(F.round(F.avg("normalized_regret"), 9).alias("raw"))


def regret_softmax(s: SparkSession, d: str) -> DataFrame:
    r = O.normalised(_methods(s, d), ["family_id"], "raw")
    return rounded(O.softmax(r.withColumn("gain", -F.col("regret")), ["family_id"], "gain", 0.15).drop("gain"))


def policy_projection(s: SparkSession, d: str) -> DataFrame:
    r = O.softmax(O.normalised(_methods(s, d), ["family_id"], "raw").withColumn("gain", -F.col("regret")), ["family_id"], "gain", 0.15).drop("gain", "raw")
    return rounded(O.projected(r, ["family_id"], "probability", "regret"))


def direct_regret_target(s: SparkSession, d: str) -> DataFrame:
    r = O.softmax(O.normalised(_methods(s, d), ["family_id"], "raw").withColumn("gain", -F.col("regret")), ["family_id"], "gain", 0.15).drop("gain", "raw")
    return rounded(O.direct_target(r, ["family_id"], "probability", "regret", 0.5))


def _policies(s: SparkSession, d: str) -> DataFrame:
    """Per family and method: regret, a parent's and an oracle's probabilities, role and validity."""
    r = O.normalised(_methods(s, d), ["family_id"], "raw").withColumn("gain", -F.col("regret"))
    r = O.softmax(O.softmax(r, ["family_id"], "gain", 0.15), ["family_id"], "gain", 0.05, "oracle")
    worse = F.avg("raw").over(Window.partitionBy("family_id")) > 0.4
    return r.withColumns({"method": F.col("predicted_method_id"), "valid": F.col("regret") < 0.9, "role": F.when(worse, "repair").otherwise("anchor")}).drop("gain")


def repair_targets(s: SparkSession, d: str) -> DataFrame:
    """Parents drawn to the oracle in families of high regret, kept where that costs nothing."""
    t = O.triggered_target(_policies(s, d), ["family_id"], "probability", "oracle", "regret", "valid", "role", 0.2, 0.1, 0.5, 0.4)
    t = O.kept_if_no_worse(t, ["family_id"], "probability", "target", "regret")
    return rounded(t.select("family_id", "predicted_method_id", "role", "pull", "kept", "taken"))


def target_checks(s: SparkSession, d: str) -> DataFrame:
    """Targets of the families as records: what is wrong with each."""
    x = _policies(s, d).groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("method", F.col("probability").alias("p"), F.col("regret").alias("r")))).alias("a"), F.min_by("method", F.struct("regret", "method")).alias("best"))
    e = P.target_errors(F.col("a.method"), F.col("a.p"), F.col("a.r"), F.col("best"))
    return x.select("family_id", F.array_join(e, "; ").alias("errors"))


def arm_targets(s: SparkSession, d: str) -> DataFrame:
    """Expected regret of three arms per family, and their weight."""
    n = F.count(F.lit(1)).over(Window.partitionBy("family_id"))
    x = _policies(s, d).withColumns({"even": 1 / n, "weight": F.when(F.col("role") == "repair", 1.5).otherwise(0.5)})
    a = O.arms(x, {"parent": F.col("probability"), "oracle": F.col("oracle"), "even": F.col("even")}, "regret", ["family_id"], "weight")
    return rounded(a.select("family_id", "arm", F.round("expected_regret", 9).alias("expected_regret"), "arm_weight").distinct())


def menu_regrets(s: SparkSession, d: str) -> DataFrame:
    """Regrets in the order of a menu of all methods of the family and the request for clarification: their number and
    their sum weighted by place."""
    g = _policies(s, d).groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "regret"))).alias("m"))
    ids = F.array_sort(F.array_union(F.map_keys("m"), F.array(F.lit("needs_clarification"))))
    v = O.regret_vector(ids, F.col("m"))
    return g.select("family_id", F.size(ids).alias("n"), F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


def boundary_points(s: SparkSession, d: str) -> DataFrame:
    """Training scenarios at the first boundary of the first two parameters of their family, a row per parameter."""
    b = table(s, d, "family_bounds").groupBy(code_key(F.col("family_id")).alias("f")).agg(*[F.map_from_entries(F.collect_list(F.struct("parameter_name", c))).alias(c) for c in ("lower_bound", "upper_bound", "is_integer")])
    x = table(s, d, "scenarios").where("parameters IS NOT NULL").select("scenario_row", id_key(F.col("split")).alias("split"), code_key(F.col("family_id")).alias("f"), "parameters").where("split = 'train'").join(b, "f")
    names = F.array_sort(F.map_keys("lower_bound"))
    moved = O.boundary(F.col("parameters"), F.col("lower_bound"), F.col("upper_bound"), F.col("is_integer"), 1, names[0], F.try_element_at(names, F.lit(2)), ["event_rate"], F.lit("n"))
    y = x.select("scenario_row", F.explode(moved).alias("parameter_name", "value"), "lower_bound").where(F.array_contains(F.map_keys("lower_bound"), F.col("parameter_name")))
    return y.where("value IS NOT NULL AND NOT isnan(value)").select("scenario_row", "parameter_name", F.round("value", 6).alias("value"))


def cvar_weights(s: SparkSession, d: str) -> DataFrame:
    m = _methods(s, d).groupBy("family_id").agg(F.round(F.avg("raw"), 9).alias("loss"))
    return rounded(O.tail_weights(m, "family_id", "loss", 0.25, 0.5))


def lhs_scenarios(s: SparkSession, d: str) -> DataFrame:
    return O.latin_hypercube(s, table(s, d, "family_bounds"), 50)


def crn_simulation(s: SparkSession, d: str) -> DataFrame:
    x = _methods(s, d).select("family_id", "predicted_method_id", F.col("raw").alias("mean"), F.lit(0.2).alias("sd"))
    return rounded(O.simulate(x, ["family_id"], "predicted_method_id"))


_ALL = [normalized_text, word_ngrams, ngram_document_frequency, ngram_overlap, contamination_flags, exact_dedup, hash_split, split_counts, split_quota, stable_sample, round_robin_strata, largest_remainder, token_ratios, token_budget_trim, repeat_to_budget, chat_validation, message_counts, extract_numbers, compact_texts, canary_routes, protected_prompts, token_windows, router_canary, code_blocks, preservation, method_tags, text_router_nb, text_routes, mmr_select, accuracy_rollup, selector_metrics, family_language_metrics, language_macro_mean, group_regret, noninferiority_gates, threshold_sweep, guard_override, paired_bootstrap, best_adapter, pairwise_cosine, split_leakage, regret_softmax, policy_projection, direct_regret_target, repair_targets, target_checks, arm_targets, menu_regrets, boundary_points, cvar_weights, lhs_scenarios, crn_simulation]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_SQ = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_W = rf"list_filter(string_split({_SQ}, ' '), lambda x : x <> '')"


def _compat() -> str:
    """Characters with a compatibility form beside it, by the rule of the Unicode data."""
    out = []
    for n in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F270), *range(0x1FBF0, 0x1FBFA)):
        c = chr(n)
        to = unicodedata.normalize("NFKD", c)
        if to != unicodedata.normalize("NFD", c):
            out.append("('{}', '{}')".format(c, to.replace("'", "''")))
    return ", ".join(out)


_COMPAT = _compat()


def plain(source: str, key: str, text: str = "text") -> str:
    """A subquery (key, text) with texts in NFKC: compatibility forms exchanged one by one, then composed."""
    return f"""(SELECT {key}, coalesce(nfc_normalize(p), {text}) AS text FROM {source} LEFT JOIN (SELECT {key}, string_agg(coalesce(t, c), '' ORDER BY i) AS p FROM
  (SELECT {key}, unnest(regexp_extract_all({text}, '(?s).')) AS c, unnest(range(length({text}))) AS i FROM {source} WHERE {text} IS NOT NULL) LEFT JOIN (VALUES {_COMPAT}) nk(c, t) USING (c) GROUP BY {key}) USING ({key}))"""


_DOCS = plain("documents", "doc_id")


def _grams(n: int, source: str = _DOCS, key: str = "doc_id") -> str:
    return f"(SELECT {key}, unnest(list_distinct([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})])) AS gram FROM (SELECT {key}, {_W} AS w FROM {source} WHERE text IS NOT NULL) WHERE len(w) >= {n})"


def _overlap(n: int, docs: str, key: str, all_docs: str) -> str:
    return f"""WITH d AS {_grams(n, docs, key)}, r AS {_grams(n, plain('routing_canary', 'canary_row'), 'canary_row')}, size AS (SELECT {key}, count(gram) AS n FROM {all_docs} LEFT JOIN d USING ({key}) GROUP BY 1),
u AS (SELECT {key}, count(*) AS a FROM d WHERE gram IN (SELECT gram FROM r) GROUP BY 1),
b AS (SELECT {key}, max(h) AS b FROM (SELECT {key}, canary_row, count(*) AS h FROM d JOIN r USING (gram) GROUP BY ALL) GROUP BY 1),
o AS (SELECT {key}, n AS n_grams, CASE WHEN n > 0 THEN round(coalesce(a, 0) / n, 6) ELSE 0.0 END AS union_ratio, CASE WHEN n > 0 THEN round(coalesce(b, 0) / n, 6) ELSE 0.0 END AS best_ratio FROM size LEFT JOIN u USING ({key}) LEFT JOIN b USING ({key}))"""


_P = """p AS (SELECT *, lower(replace(trim(family_id), '-', '_')) AS f, lower(replace(trim(language), '-', '_')) AS l,
  CASE WHEN isnan(normalized_regret) THEN NULL ELSE normalized_regret END AS r, (predicted_method_id = oracle_method_id) AS ok FROM predictions)"""
_M = f"WITH {_P}, m AS (SELECT f AS family_id, predicted_method_id, round(avg(r), 9) AS raw FROM p WHERE r IS NOT NULL AND predicted_method_id IS NOT NULL GROUP BY ALL), n AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w > 1e-12 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0.0 END AS regret FROM m WINDOW w AS (PARTITION BY family_id)), e AS (SELECT *, exp(-regret / 0.15) AS e FROM n), s AS (SELECT *, e / sum(e) OVER (PARTITION BY family_id) AS probability FROM e)"


_POLICIES = f"{_M}, o AS (SELECT *, exp(-regret / 0.05) AS oe, CASE WHEN avg(raw) OVER (PARTITION BY family_id) > 0.4 THEN 'repair' ELSE 'anchor' END AS role FROM s), q AS (SELECT *, oe / sum(oe) OVER (PARTITION BY family_id) AS oracle FROM o)"


def _greedy(order: str, budget: int, repeats: int) -> str:
    return f"""WITH RECURSIVE o AS (SELECT doc_id, coalesce(nullif(lower(replace(trim(lang), '-', '_')), ''), '?') AS lang, n_chars, r::INT AS repeat_index, row_number() OVER (PARTITION BY coalesce(nullif(lower(replace(trim(lang), '-', '_')), ''), '?') ORDER BY r, {order}, doc_id) AS k FROM documents, range({repeats}) x(r) WHERE n_chars > 0),
g AS (SELECT *, true AS keep, {budget} - n_chars AS room FROM o WHERE k = 1 UNION ALL
  SELECT o.*, o.n_chars <= g.room, g.room - CASE WHEN o.n_chars <= g.room THEN o.n_chars ELSE 0 END FROM g JOIN o ON o.lang = g.lang AND o.k = g.k + 1)
SELECT lang, doc_id, repeat_index, n_chars AS tokens FROM g WHERE keep"""


_ROUTER = f"""WITH c AS (SELECT canary_row, coalesce(nullif(lower(replace(trim(family_id), '-', '_')), ''), 'none') AS family, ('0x' || substr(sha256(r.text), 1, 1))::INT % 2 AS half,
  '^' || trim(regexp_replace(regexp_replace(lower(n.text), '[0-9]+([.][0-9]+)?', '0', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') || '$' AS t FROM routing_canary r JOIN {plain('routing_canary', 'canary_row')} n USING (canary_row) WHERE r.text IS NOT NULL),
f AS (SELECT canary_row, family, half, g, least(count(*), 3) AS tf FROM (SELECT canary_row, family, half, unnest(flatten([[t[i:i + k - 1] FOR i IN range(1, length(t) - k + 2)] FOR k IN [2, 3, 4]])) AS g FROM c) GROUP BY ALL),
v AS (SELECT g FROM f WHERE half = 0 GROUP BY g HAVING count(*) >= 2 ORDER BY count(*) DESC, g LIMIT 20000),
n AS (SELECT family AS class, g, sum(tf) AS n FROM f JOIN v USING (g) WHERE half = 0 GROUP BY ALL),
k AS (SELECT DISTINCT family AS class FROM c WHERE half = 0),
m AS (SELECT k.class, v.g, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY k.class) AS t, (SELECT count(*) FROM v) AS size FROM k CROSS JOIN v LEFT JOIN n ON n.class = k.class AND n.g = v.g),
p AS (SELECT class, g, ln((n + 0.5) / (t + 0.5 * size))::FLOAT::DOUBLE AS lp FROM m),
s AS (SELECT canary_row, class, sum(tf * lp) / sqrt(sum(tf)) AS s FROM f JOIN p USING (g) WHERE half = 1 GROUP BY ALL),
best AS (SELECT c.family, c.canary_row, k.class AS predicted FROM c CROSS JOIN k LEFT JOIN s ON s.canary_row = c.canary_row AND s.class = k.class WHERE c.half = 1 QUALIFY row_number() OVER (PARTITION BY c.canary_row ORDER BY coalesce(s, 0) DESC, k.class) = 1)"""


def _sel(by: list[tuple[str, str]], sets: str, source: str = "p") -> str:
    cols = ", ".join(f"{e} AS {a}" for a, e in by)
    return f"SELECT grouping({', '.join(e for _, e in by)}) AS level, {cols}, count(*) AS n, round(avg(r), 6) AS mean_regret, round(avg(ok::INT), 6) AS accuracy, round(avg((NOT valid)::INT), 6) AS invalid_rate FROM {source} GROUP BY {sets}"


def oracle_sql() -> dict[str, str]:
    split = "CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'valid' ELSE 'test' END"
    bucket = "(SELECT doc_id, source, (('0x' || substr(sha256('42:' || doc_id), 1, 16))::UBIGINT % 100)::INT AS b FROM documents)"
    lang = "lower(replace(trim(lang), '-', '_'))"
    both = f"WITH {_P}, a AS (SELECT p.*, parent_adapter_id IS NULL AS is_parent FROM p JOIN adapters USING (adapter_id) WHERE l IS NOT NULL AND r IS NOT NULL), m AS (SELECT f AS family_id, l AS language, is_parent, round(avg(r), 9) AS regret FROM a GROUP BY ALL)"
    user = "list_filter(messages, lambda x : x.role = 'user')[1].content"
    order = "('0x' || substr(sha256('0:' || doc_id), 1, 15))::BIGINT"
    msg = "(SELECT record_id, unnest(messages) AS m, unnest(range(len(messages)::BIGINT)) AS pos FROM chat_records)"
    return {
        "normalized_text": f"SELECT doc_id, md5({_SQ}) AS digest, length({_SQ}) AS n FROM {_DOCS}",
        "word_ngrams": f"SELECT doc_id, count(*) AS n_grams, md5(array_to_string(list_sort(list(gram)), '|')) AS digest FROM {_grams(3)} GROUP BY doc_id",
        "ngram_document_frequency": f"SELECT gram, count(*) AS df FROM {_grams(2)} GROUP BY gram HAVING count(*) >= 2 ORDER BY df DESC, gram LIMIT 100",
        "ngram_overlap": f"{_overlap(4, _DOCS, 'doc_id', 'documents')} SELECT * FROM o",
        "contamination_flags": f"{_overlap(8, plain('(SELECT record_id, ' + user + ' AS text FROM chat_records)', 'record_id'), 'record_id', 'chat_records')} SELECT record_id, n_grams, best_ratio, best_ratio >= 0.5 AS contaminated FROM o",
        "exact_dedup": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_SQ}) AS kept_key FROM {_DOCS} WHERE text IS NOT NULL",
        "compact_texts": r"""WITH c AS (SELECT record_id, list_filter(messages, lambda x : x.role = 'user')[1].content AS q, list_filter(messages, lambda x : x.role = 'assistant')[1].content AS a FROM chat_records),
t AS (SELECT *, regexp_replace(trim(regexp_replace(q, '(?s)\n\s*\n[^\n]{0,24}[:：]\s*\nA[.)：].*$', ''), ' '), '^\s*(?:(?:problem|question|exercise|example|task|item|q|第)\s*#?\d+\s*(?:題|题)?|#\d+)\s*[.:：)、-]*\s*', '', 'i') AS question, trim(string_split(a, '</think>')[-1], ' ') AS said, nullif(trim(regexp_extract(a, '(?s)<method>(.*?)</method>', 1), ' '), '') AS tag FROM c),
u AS (SELECT *, trim(regexp_replace(regexp_replace(said, '(?s)<method>.*?</method>', '', 'g'), '(?s)<plan>.*?</plan>', '', 'g'), ' ') AS answer, list_transform(regexp_extract_all(said, '(?s)```[^\n]*\n(.*?)```', 1), lambda x : regexp_replace(x, '\s+$', '')) AS blocks, trim(regexp_replace(lower(a), '\s+', ' ', 'g'), ' ') AS sa, trim(regexp_replace(lower(tag), '\s+', ' ', 'g'), ' ') AS sg FROM t),
w AS (SELECT *, contains(' ' || regexp_replace(sa, '[^\p{L}\p{N}_.-]+', ' ', 'g') || ' ', ' ' || regexp_replace(sg, '[^\p{L}\p{N}_.-]+', ' ', 'g') || ' ') AS inside FROM u)
SELECT record_id, md5(question) AS question, md5(answer) AS answer, CASE WHEN said IS NOT NULL THEN coalesce(list_max(list_transform(blocks, lambda x : length(x))), 0)::INT END AS block,
  md5(concat_ws(chr(10) || chr(10), CASE WHEN trim(question, ' ') <> '' THEN 'Question:' || chr(10) || trim(question, ' ') END, CASE WHEN trim(answer, ' ') <> '' THEN 'Answer:' || chr(10) || trim(answer, ' ') END)) AS both, sa = sg OR ends_with(sa, sg) OR inside AS names_method FROM w""",
        "hash_split": f"SELECT doc_id, {split} AS split FROM {bucket}",
        "split_counts": f"SELECT {split} AS split, count(*) AS n FROM {bucket} GROUP BY 1",
        "split_quota": f"SELECT doc_id, source, split, position FROM (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY {order}, doc_id) AS position FROM (SELECT doc_id, nullif(lower(trim(source)), '') AS source, {split} AS split FROM {bucket})) WHERE position <= CASE split WHEN 'train' THEN 44 ELSE 3 END",
        "stable_sample": "SELECT doc_id, sha256('7:' || doc_id) AS order_hash FROM documents ORDER BY order_hash, doc_id LIMIT 100",
        "round_robin_strata": f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order}, doc_id) AS turn FROM (SELECT doc_id, nullif({lang}, '') AS lang FROM documents)",
        "token_budget_trim": _greedy(order, 20_000, 1),
        "repeat_to_budget": _greedy(order, 100_000, 3),
        "extract_numbers": r"SELECT doc_id, len(n)::INT AS n_numbers, md5(array_to_string(n, '|')) AS digest FROM (SELECT doc_id, list_transform(list_filter(list_zip(regexp_extract_all(' ' || text, '((?:^|[^A-Za-z0-9_.]))-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[A-Za-z0-9_.]+|(?s).', 0), regexp_extract_all(' ' || text, '(?:^|[^A-Za-z0-9_.])(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|[A-Za-z0-9_.]+|(?s).', 1)), lambda x : x[2] <> ''), lambda x : x[2]) AS n FROM documents WHERE text IS NOT NULL)",
        "text_router_nb": f"{_ROUTER} SELECT family AS label, predicted, count(*) AS n FROM best GROUP BY ALL",
        "largest_remainder": f"""WITH c AS (SELECT coalesce({lang}, '?') AS lang, count(*) * 97.0 / (SELECT count(*) FROM documents) AS x FROM documents GROUP BY 1),
r AS (SELECT lang, floor(x) AS lo, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, lang) AS k, 97 - sum(floor(x)) OVER () AS spare FROM c) SELECT lang, (lo + (k <= spare)::INT)::BIGINT AS n FROM r""",
        "token_ratios": f"""WITH d AS (SELECT {lang} AS lang, domain, coalesce(n_chars, 0) AS c FROM documents)
SELECT grouping(lang, domain) AS level, lang, domain, count(*) AS n_rows, sum(c)::BIGINT AS tokens, round(sum(c) / (SELECT sum(c) FROM d), 4) AS ratio FROM d GROUP BY GROUPING SETS ((), (lang), (domain))""",
        "message_counts": f"SELECT m.role AS role, count(*) AS n, sum(length(m.content))::BIGINT AS chars, count(DISTINCT record_id) AS n_records FROM {msg} GROUP BY 1",
        "chat_validation": f"""WITH c AS (SELECT record_id, metadata AS d, messages AS m, list_transform(messages, lambda x : x.role) AS r FROM chat_records)
SELECT record_id, unnest(list_filter([CASE WHEN m IS NULL OR len(m) < 2 THEN 'fewer than two messages' END,
  CASE WHEN coalesce(list_filter(r, lambda x : x <> 'system')[1], '') <> 'user' THEN 'first message is not the user''s' END,
  CASE WHEN coalesce(r[-1], '') <> 'assistant' THEN 'last message is not the assistant''s' END,
  CASE WHEN len(list_filter(r, lambda x : x NOT IN ('system', 'user', 'assistant', 'tool'))) > 0 THEN 'unknown role' END,
  CASE WHEN len(list_filter(m, lambda x : coalesce(trim(x.content, ' '), '') = '')) > 0 THEN 'empty content' END,
  {', '.join(f"CASE WHEN d.{k} IS NULL THEN 'missing {k}' END" for k in ('source_id', 'source_repo', 'source_revision', 'source_license', 'domain', 'language'))}], lambda x : x IS NOT NULL)) AS error FROM c""",
        "code_blocks": rf"SELECT record_id, pos, len(b) AS n_blocks, md5(array_to_string(list_transform(b, lambda x : regexp_replace(x, '\s+$', '')), chr(10))) AS digest FROM (SELECT record_id, pos, regexp_extract_all(m.content, '(?s)```[^\n]*\n(.*?)```', 1) AS b FROM {msg} WHERE m.role = 'assistant' AND m.content LIKE '%```%')",
        "accuracy_rollup": f"WITH {_P} SELECT grouping(domain, l, f) AS level, domain, l AS language, f AS family_id, count(ok) AS n, round(avg(ok::INT), 4) AS accuracy FROM p GROUP BY GROUPING SETS ((), (domain), (l), (f))",
        "selector_metrics": f"WITH {_P} " + _sel([("domain", "domain"), ("family_id", "f")], "GROUPING SETS ((), (domain), (f))"),
        "family_language_metrics": f"WITH {_P} " + _sel([("family_id", "f"), ("language", "l")], "CUBE (f, l)"),
        "guard_override": f"WITH {_P}, g AS (SELECT domain, CASE WHEN normalized_regret > 0.8 THEN 1.0 ELSE r END AS r, CASE WHEN normalized_regret > 0.8 THEN 'needs_clarification' = oracle_method_id ELSE ok END AS ok, CASE WHEN normalized_regret > 0.8 THEN false ELSE valid END AS valid FROM p) " + _sel([("domain", "domain")], "GROUPING SETS ((), (domain))", "g"),
        "language_macro_mean": f"WITH {_P}, m AS (SELECT f, l, avg(r) AS m FROM p WHERE l IS NOT NULL GROUP BY ALL) SELECT f AS family_id, count(m) AS n_groups, round(avg(m), 6) AS macro_mean FROM m GROUP BY f",
        "group_regret": f"WITH {_P} SELECT slug, f AS family_id, count(r) AS n, round(avg(r), 6) AS mean_regret FROM p JOIN adapters USING (adapter_id) WHERE r IS NOT NULL GROUP BY ALL",
        "noninferiority_gates": f"{both} SELECT family_id, language, round(a.regret, 6) AS parent_value, round(b.regret, 6) AS candidate_value, coalesce(round(b.regret - a.regret, 12) <= 0.01, false) AS passed FROM (FROM m WHERE is_parent) a FULL JOIN (FROM m WHERE NOT is_parent) b USING (family_id, language)",
        "threshold_sweep": f"WITH {_P} SELECT t / 10.0 AS threshold, count(*) FILTER (1 - r >= t / 10.0::DOUBLE) AS routed, coalesce(sum(ok::INT) FILTER (1 - r >= t / 10.0::DOUBLE), 0)::BIGINT AS hits FROM p, range(1, 10) x(t) WHERE r IS NOT NULL GROUP BY t",
        "best_adapter": f"WITH {_P}, m AS (SELECT f AS family_id, adapter_id, round(avg(r), 9) AS regret, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT family_id, adapter_id, round(regret, 6) AS regret, n FROM m QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY regret, adapter_id) = 1",
        "split_leakage": "SELECT lower(trim(blueprint_id)) AS blueprint_id FROM scenarios WHERE lower(trim(split)) = 'train' INTERSECT SELECT lower(trim(blueprint_id)) FROM scenarios WHERE lower(trim(split)) IN ('valid', 'dev', 'final')",
        "pairwise_cosine": """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.label = b.label AS same, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT (SELECT count(*) FROM u) AS n, round(avg(c) FILTER (same), 6) AS mean_within, round(avg(c) FILTER (NOT same), 6) AS mean_across FROM p""",
        "regret_softmax": f"{_M} SELECT family_id, predicted_method_id, round(raw, 6) AS raw, round(regret, 6) AS regret, round(probability, 6) AS probability FROM s",
        "direct_regret_target": f"{_M}, t AS (SELECT *, greatest(0, probability * (1 - 0.5 * (regret - sum(probability * regret) OVER (PARTITION BY family_id)))) AS q FROM s) SELECT family_id, predicted_method_id, round(regret, 6) AS regret, round(probability, 6) AS probability, round(q / sum(q) OVER (PARTITION BY family_id), 6) AS target FROM t",
        "policy_projection": f"""{_M}, a AS (SELECT *, (0.9 * probability + 0.1 / count(*) OVER w) * exp(-2 * regret) AS t FROM s WINDOW w AS (PARTITION BY family_id)),
q AS (SELECT *, 0.5 * probability + 0.5 * t / sum(t) OVER w AS q FROM a WINDOW w AS (PARTITION BY family_id)),
g AS (SELECT *, sum(q * regret) OVER w <= sum(probability * regret) OVER w + 1e-12 AS accepted FROM q WINDOW w AS (PARTITION BY family_id)),
j AS (SELECT *, CASE WHEN accepted THEN q ELSE probability END AS j FROM g)
SELECT family_id, predicted_method_id, round(regret, 6) AS regret, round(probability, 6) AS probability, accepted, round(j, 6) AS projected, round(sum(j * ln(j / probability)) OVER (PARTITION BY family_id), 6) AS kl FROM j""",
        "repair_targets": f"""{_POLICIES}, ee AS (SELECT *, sum(probability * regret) OVER w AS mine, sum(oracle * regret) OVER w AS best, first_value(regret < 0.9) OVER (PARTITION BY family_id ORDER BY probability DESC, predicted_method_id) AS top FROM q WINDOW w AS (PARTITION BY family_id)),
cc AS (SELECT *, 0.1 + 0.4 * greatest(0, least(1, (mine - 0.2) / 0.8)) AS c FROM ee),
l AS (SELECT *, CASE WHEN role = 'repair' AND best < mine - 1e-12 THEN least(0.5, CASE WHEN NOT top THEN greatest(c, 0.4) ELSE c END) ELSE 0.0 END AS pull FROM cc),
t AS (SELECT *, (1 - pull) * probability + pull * oracle AS target FROM l), k AS (SELECT *, sum(target * regret) OVER (PARTITION BY family_id) <= mine + 1e-10 AS taken FROM t)
SELECT family_id, predicted_method_id, role, round(pull, 6) AS pull, round(CASE WHEN taken THEN target ELSE probability END, 6) AS kept, taken FROM k""",
        "target_checks": f"{_POLICIES} SELECT family_id, concat_ws('; ', CASE WHEN count(*) > 6 THEN 'too many candidates' END, CASE WHEN abs(sum(probability) - 1) > 1e-7 THEN 'probabilities do not sum to one' END) AS errors FROM q GROUP BY 1",
        "arm_targets": f"{_POLICIES}, a AS (SELECT family_id, role, sum(probability * regret) AS parent, sum(oracle * regret) AS oracle, avg(regret) AS even FROM q GROUP BY ALL), u AS (UNPIVOT a ON parent, oracle, even INTO NAME arm VALUE r) SELECT family_id, arm, round(round(r, 9), 6) AS expected_regret, CASE role WHEN 'repair' THEN 1.5 ELSE 0.5 END::DOUBLE AS arm_weight FROM u",
        "menu_regrets": f"{_POLICIES}, x AS (SELECT family_id, predicted_method_id AS m, CASE WHEN predicted_method_id = 'needs_clarification' THEN 1.0 ELSE regret END AS r FROM q UNION SELECT DISTINCT family_id, 'needs_clarification', 1.0 FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY m) AS k FROM x) SELECT family_id, count(*)::INT AS n, round(sum(k * r), 6) AS weighted FROM k GROUP BY 1",
        "boundary_points": """WITH b AS (SELECT lower(replace(trim(family_id), '-', '_')) AS f, parameter_name AS p, lower_bound AS lo, upper_bound AS hi, is_integer AS i, row_number() OVER (PARTITION BY lower(replace(trim(family_id), '-', '_')) ORDER BY parameter_name) AS k FROM family_bounds),
v AS (SELECT scenario_row, p, lo, hi, i, parameters[p] AS v, CASE WHEN p = 'n' THEN 0.8 WHEN k = 2 THEN 0.82 WHEN k = 1 THEN 0.82 END AS q FROM scenarios JOIN b ON b.f = lower(replace(trim(family_id), '-', '_')) WHERE lower(trim(split)) = 'train' AND parameters IS NOT NULL AND map_contains(parameters, p)),
w AS (SELECT *, lo + CASE WHEN p = 'event_rate' THEN 1 - q ELSE q END * (hi - lo) AS x FROM v),
r AS (SELECT scenario_row, p AS parameter_name, CASE WHEN q IS NULL THEN v WHEN i THEN greatest(round(x), 2) ELSE x END AS value FROM w)
SELECT scenario_row, parameter_name, round(value, 6) AS value FROM r WHERE value IS NOT NULL AND NOT isnan(value)""",
        "cvar_weights": f"{_M}, l AS (SELECT family_id, round(avg(raw), 9) AS loss FROM m GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY loss DESC, family_id) AS k, count(*) OVER () AS n, greatest(1, round_even(count(*) OVER () * 0.25, 0)) AS tail FROM l) SELECT family_id, round(loss, 6) AS loss, round(0.5 + CASE WHEN k <= tail THEN 0.5 * n / tail ELSE 0 END, 6) AS weight FROM k",
    }
