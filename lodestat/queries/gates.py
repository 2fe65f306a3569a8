"""Gates, picks, messages, set operations and the incremental stream over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import text as X
from lodestat.functions.keys import code_key, id_key
from lodestat.operators import curate as U
from lodestat.operators import evaluate as E
from lodestat.operators import gates as G
from lodestat.operators import policy as O
from lodestat.operators import selection as L
from lodestat.plans import compiler
from lodestat.session import shared_folder
from lodestat.sources.tables import table
from lodestat.streaming import incremental as S


def _pred(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "predictions")
    r = F.when(~F.isnan("normalized_regret"), F.col("normalized_regret"))
    return p.select("prediction_id", id_key(F.col("blueprint_id")).alias("blueprint_id"), code_key(F.col("family_id")).alias("family_id"), "domain", code_key(F.col("language")).alias("language"), "adapter_id", "predicted_method_id", "oracle_method_id", r.alias("regret"), "valid")


def _slugs(s: SparkSession, d: str) -> DataFrame:
    """One prediction per blueprint, language and slug: that with the smallest id."""
    a = table(s, d, "adapters").select("adapter_id", "slug")
    p = _pred(s, d).where("blueprint_id IS NOT NULL AND language IS NOT NULL AND regret IS NOT NULL").join(a, "adapter_id")
    return p.groupBy("blueprint_id", "language", "slug").agg(F.min_by("regret", "prediction_id").alias("regret"), F.min_by("family_id", "prediction_id").alias("family_id"))


def routed_pick(s: SparkSession, d: str) -> DataFrame:
    """Every blueprint and language routed to the expert, to the parent where there is none."""
    p = _slugs(s, d)
    keys = p.where("slug IN ('expert', 'parent')").select("blueprint_id", "language").distinct().withColumn("slug", F.lit("expert"))
    return E.routed_pick(keys, p.drop("family_id"), ["blueprint_id", "language"]).select("blueprint_id", "language", F.round("regret", 6).alias("regret"))


def replaced_rows(s: SparkSession, d: str) -> DataFrame:
    p = _slugs(s, d)
    base, other = (p.where(F.col("slug") == v).drop("slug") for v in ("parent", "repair"))
    return E.replaced(base, other, ["blueprint_id", "language"]).groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("regret"), 6).alias("mean_regret"))


def paired_coverage(s: SparkSession, d: str) -> DataFrame:
    p = _slugs(s, d)
    x = E.paired(p.where("slug = 'parent'"), p.where("slug = 'expert'"), ["blueprint_id", "language"], "regret")
    return x.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("paired"), 1)).alias("n_paired"), F.round(F.avg("difference"), 6).alias("mean_difference"))


def culprit_families(s: SparkSession, d: str) -> DataFrame:
    p = _slugs(s, d)
    keys = ["blueprint_id", "language", "family_id"]
    a = p.where("slug = 'parent'").select(*keys, F.col("regret").alias("before"))
    b = p.where("slug = 'expert'").select(*keys, F.col("regret").alias("after"))
    return G.culprits(a.join(b, keys), "family_id", "before", "after")


def guard_metrics(s: SparkSession, d: str) -> DataFrame:
    return G.guard_metrics(_pred(s, d), ~F.col("valid"), F.col("regret") > 0.8, ["family_id", "language"])


def promotion_gates(s: SparkSession, d: str) -> DataFrame:
    m = _pred(s, d).groupBy("adapter_id").agg(F.count(F.lit(1)).alias("n"), F.avg("regret").alias("r"), F.avg((F.col("predicted_method_id") == F.col("oracle_method_id")).cast("double")).alias("a"), F.avg((~F.col("valid")).cast("double")).alias("i"))
    g = G.gate_vector(m, {"enough_rows": F.col("n") >= 50, "regret": F.col("r") <= 0.45, "accuracy": F.col("a") >= 0.4, "invalid": F.col("i") <= 0.25})
    return g.select("adapter_id", "n", "enough_rows", "regret", "accuracy", "invalid", "failed", "passed")


def data_gate(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chat_records")
    checks = {
        "has_messages": F.size("messages") > 1,
        "ends_with_assistant": F.try_element_at("messages", F.lit(-1))["role"] == "assistant",
        "known_split": id_key(F.col("metadata.split")).isin("train", "valid", "test"),
        "known_language": code_key(F.col("metadata.language")).isin("en", "zh_hant", "zh_hans"),
        "has_repo": F.col("metadata.source_repo").isNotNull(),
        "has_tokens": F.col("metadata.token_count") > 0,
    }
    return G.check_table(c, checks)


def role_picks(s: SparkSession, d: str) -> DataFrame:
    """Per family ten predictions to repair and ten anchors: the picks are the feature."""
    p = _pred(s, d).where("regret IS NOT NULL AND valid IS NOT NULL").select("prediction_id", "family_id", "regret", "valid")
    return G.role_picks(p, ["family_id"], "prediction_id", [F.col("valid"), F.desc("regret"), F.col("prediction_id")], [F.desc("valid"), F.col("regret"), F.col("prediction_id")], 10, 10).select("prediction_id", "family_id", "role")


def hash_picks(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "scenarios").select("scenario_row", code_key(F.col("family_id")).alias("family_id"))
    return G.hash_picks(p, ["family_id"], "scenario_row", 5, 42)


def rank_failures(s: SparkSession, d: str) -> DataFrame:
    """Top-100 report of invalid predictions."""
    p = _pred(s, d).where("NOT valid AND regret IS NOT NULL")
    return p.orderBy(F.desc("regret"), "prediction_id").limit(100).select("prediction_id", F.round("regret", 6).alias("regret"))


def regret_quantiles(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d).groupBy("family_id").agg(F.percentile("regret", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return p.select("family_id", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "median", "high"))])


def weighted_regret(s: SparkSession, d: str) -> DataFrame:
    return G.weighted_mean(_pred(s, d), ["domain"], F.col("regret"), F.when(F.col("valid"), 1.0).otherwise(0.5))


def method_sets(s: SparkSession, d: str) -> DataFrame:
    """Methods predicted, oracle, both, only predicted."""
    p = _pred(s, d)
    a = p.select(F.col("predicted_method_id").alias("m")).where("m IS NOT NULL").distinct()
    b = p.select(F.col("oracle_method_id").alias("m")).where("m IS NOT NULL").distinct()
    name = lambda x, n: x.select(F.col("m").alias("method_id"), F.lit(n).alias("part"))
    return name(a.union(b).distinct(), "union").union(name(a.intersect(b), "both")).union(name(a.subtract(b), "only_predicted"))


def user_text(s: SparkSession, d: str) -> DataFrame:
    """Joined and last user contents of a record."""
    m = F.transform(F.filter("messages", lambda x: x["role"] == "user"), lambda x: x["content"])
    return table(s, d, "chat_records").select("record_id", F.md5(F.array_join(m, "\n")).alias("joined"), F.md5(F.try_element_at(m, F.lit(-1))).alias("last"), F.size(m).alias("n_user"))


def candidate_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.substring(F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), "text"), 256), 1, 24).alias("candidate_id"))


def bound_texts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "family_bounds")
    return b.select("family_id", "parameter_name", X.number_text(F.col("lower_bound")).alias("low"), X.number_text(F.col("upper_bound")).alias("high"))


def prompt_percentages(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "routing_canary").select("canary_row", F.expr("try_cast(nullif(regexp_extract(text, '([0-9]+(?:[.][0-9]+)?)%', 1), '') AS DOUBLE)").alias("p"))
    return t.where("p IS NOT NULL").select("canary_row", F.col("p").alias("percent"))


def selected_tokens(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    t = U.selected_tokens(F.transform("embedding", lambda x: x.cast("double")), 1, 0.25, 0.0)
    return e.select("vec_id", F.size(t).alias("n_kept"), F.array_min(t).alias("first_kept"))


def _points(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    x = table(s, d, "scenarios").select("scenario_row", code_key(F.col("family_id")).alias("family_id"), id_key(F.col("split")).alias("split"), "parameters").where("parameters IS NOT NULL")
    ranges: dict[str, dict[str, float]] = {}
    for r in table(s, d, "family_bounds").select(code_key(F.col("family_id")).alias("f"), "parameter_name", (F.col("upper_bound") - F.col("lower_bound")).alias("w")).collect():  # a fixed table
        ranges.setdefault(r["f"], {})[r["parameter_name"]] = r["w"]
    return x.withColumn("parameters", F.map_filter("parameters", lambda k, v: v.isNotNull() & ~F.isnan(v))), ranges


def novelty_of_queries(s: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest other training scenario of the family, for every row whose number is divisible
    by 100 (the stated set of queries), against all training rows."""
    x, ranges = _points(s, d)
    out = O.novelty(x.where("scenario_row % 100 = 0"), x.where("split = 'train'"), "family_id", "scenario_row", "parameters", ranges)
    return out.select(F.col("key").alias("scenario_row"), F.round("novelty", 6).alias("novelty"))


def nearest_history(s: SparkSession, d: str) -> DataFrame:
    """The nearest other training scenario by the largest difference, for the same set of queries."""
    x, ranges = _points(s, d)
    out = O.nearest(x.where("scenario_row % 100 = 0"), x.where("split = 'train'"), "family_id", "scenario_row", "parameters", ranges, largest=True)
    return out.select(F.col("key").alias("scenario_row"), F.round("novelty", 6).alias("distance"), F.col("nearest"))


def stream_window_counts(s: SparkSession, d: str) -> DataFrame:
    """Extension: daily counts of the event files as a stream, to a table in the shared folder. Windows are
    written once the watermark has passed them; the last ones by a closing row far ahead, which is left out."""
    base = shared_folder(s) + f"/stream-{uuid.uuid4().hex}"
    events = table(s, d, "events")
    end = events.agg(F.max(F.col("ts").cast("timestamp")).alias("t"))
    close = end.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("ts", "event_type") else (F.col("t") + F.expr("INTERVAL 30 DAYS")).cast(f.dataType).alias("ts") if f.name == "ts" else F.lit("end").alias("event_type") for f in events.schema])
    close.write.parquet(f"{base}/close")

    def run(path: str) -> None:
        e = S.file_stream(s, path, events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        w = S.windowed_counts(e, "ts", "event_type", "1 day")
        w.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    links = f"{base}/in"
    events.write.parquet(links)
    run(links)
    for _ in range(2):  # one moves the watermark on, the next writes what it has passed
        s.read.parquet(f"{base}/close").write.mode("append").parquet(links)
        run(links)
    return s.read.parquet(f"{base}/out").where("event_type != 'end'").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


#: Most characters of an admitted prompt and answer together, and admitted rows per split and language.
_ADMIT_CHARS, _ADMIT_QUOTA = 3000, 400


def admission_reasons(s: SparkSession, d: str) -> DataFrame:
    """Why each record is or is not admitted: the first rule that holds, in the order of the cascade. Quota is counted
    among the rows that pass the earlier rules, before copies are looked for."""
    m = F.col("messages")
    user = F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(1))["content"]
    reply = F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(1))["content"]
    c = table(s, d, "chat_records").select("record_id", user.alias("user"), reply.alias("answer"), id_key(F.col("metadata.split")).alias("split"), code_key(F.col("metadata.language")).alias("language"))
    canary = table(s, d, "routing_canary").where("text IS NOT NULL").select(F.sha2(X.squeeze(F.col("text")), 256).alias("h")).distinct()
    own = lambda x: F.sha2(X.squeeze(F.col(x)), 256)
    early = [("missing_content", (F.coalesce(F.trim("user"), F.lit("")) == "") | (F.coalesce(F.trim("answer"), F.lit("")) == "")), ("unfinished", F.regexp_count("answer", F.lit("```")) % 2 == 1), ("missing_split", F.col("split").isNull() | F.col("language").isNull())]
    late = [("too_long", F.length("user") + F.length("answer") > _ADMIT_CHARS)]
    return L.admitted(c.withColumn("h", own("user")), "record_id", early, ["split", "language"], _ADMIT_QUOTA, "h", canary, late).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def temperature_choice(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d).where("regret IS NOT NULL AND predicted_method_id IS NOT NULL AND oracle_method_id IS NOT NULL").withColumn("confidence", 0.05 + 0.9 * (1 - F.col("regret")))
    return L.temperature_choice(p, "confidence", F.col("predicted_method_id") == F.col("oracle_method_id"), [0.5, 0.75, 1.0, 1.5, 2.0])


def complete_groups(s: SparkSession, d: str) -> DataFrame:
    """Blueprints whose predictions cover all three languages, each once."""
    p = _pred(s, d).where("blueprint_id IS NOT NULL AND language IS NOT NULL")
    return L.complete_groups(p, "blueprint_id", "language", ["en", "zh_hant", "zh_hans"])


def replay_sample(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "scenarios").select("scenario_row", id_key(F.col("blueprint_id")).alias("blueprint_id"), F.coalesce("source", F.lit("")).alias("source"))
    new, old = x.where("source LIKE 'cycles/%'"), x.where("source NOT LIKE 'cycles/%'")
    return L.replay_sample(new, old, "blueprint_id", 0.2).groupBy("part").agg(F.countDistinct("blueprint_id").alias("n_groups"))


def importance_weights(s: SparkSession, d: str) -> DataFrame:
    return L.importance_weights(_pred(s, d).where("language IS NOT NULL"), "language", {"en": 0.5, "zh_hant": 0.25, "zh_hans": 0.25})


def menus(s: SparkSession, d: str) -> DataFrame:
    """Per blueprint the methods its predictions name, as a menu."""
    p = _pred(s, d).where("blueprint_id IS NOT NULL AND predicted_method_id IS NOT NULL")
    g = p.groupBy("blueprint_id").agg(F.array_sort(F.collect_set("predicted_method_id")).alias("c"))
    return g.select("blueprint_id", F.array_join(F.transform(L.menu(F.col("c"), F.col("blueprint_id")), lambda x: F.concat(x["label"], F.lit(". "), x["method"])), "\n").alias("menu"))


def scenario_mutations(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "family_bounds").groupBy(code_key(F.col("family_id")).alias("f")).agg(*[F.map_from_entries(F.collect_list(F.struct("parameter_name", c))).alias(c) for c in ("lower_bound", "upper_bound", "is_integer")])
    x = table(s, d, "scenarios").where("parameters IS NOT NULL").select("scenario_row", code_key(F.col("family_id")).alias("f"), "parameters").join(b, "f")
    return x.select("scenario_row", L.mutated(F.col("parameters"), F.col("scenario_row"), F.col("lower_bound"), F.col("upper_bound"), F.col("is_integer")).alias("parameters"))


def capped_picks(s: SparkSession, d: str) -> DataFrame:
    """Forty predictions: the best of each family first, then by regret, at most 8 of a family and 6 of a method."""
    p = _pred(s, d).where("regret IS NOT NULL AND predicted_method_id IS NOT NULL AND family_id IS NOT NULL").withColumn("reward", -F.col("regret"))
    return L.capped_picks(p.select("family_id", "predicted_method_id", "prediction_id", "reward"), "family_id", "predicted_method_id", "prediction_id", "reward", 40, 8, 6).select("family_id", "prediction_id", "rank")


def guard_choice(s: SparkSession, d: str) -> DataFrame:
    """Thresholds of a guard on the regret: pooled and worst-group rates, the gates failed, and the one chosen."""
    grid = G.guard_grid(_pred(s, d), ~F.col("valid"), F.col("regret"), ["domain"], [i / 20 for i in range(1, 20)])
    out = G.eligible_best(grid.withColumnsRenamed({"sensitivity": "s", "specificity": "q"}), {"sensitivity": F.col("s") >= 0.3, "specificity": F.col("q") >= 0.3, "worst": F.col("min_specificity") >= 0.2}, [F.desc("s"), F.desc("q"), F.col("threshold")])
    return out.withColumnsRenamed({"s": "sensitivity", "q": "specificity"})


def adapter_choice(s: SparkSession, d: str) -> DataFrame:
    """Per family the adapter: not worse than the family's mean regret by more than .02, enough rows, few invalid ones;
    then least regret, largest accuracy, name."""
    p = _pred(s, d).where("regret IS NOT NULL AND family_id IS NOT NULL")
    m = p.groupBy("family_id", "adapter_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("regret"), 9).alias("mean_regret"), F.round(F.avg(F.coalesce((F.col("predicted_method_id") == F.col("oracle_method_id")).cast("double"), F.lit(0.0))), 9).alias("accuracy"), F.round(F.avg((~F.col("valid")).cast("double")), 9).alias("invalid"))
    whole = p.groupBy("family_id").agg(F.round(F.avg("regret"), 9).alias("all_regret"))
    out = G.eligible_best(m.join(whole, "family_id"), {"rows": F.col("n") >= 5, "regret": F.col("mean_regret") <= F.col("all_regret") + 0.02, "valid": F.col("invalid") <= 0.5}, [F.col("mean_regret"), F.desc("accuracy"), F.col("adapter_id")], ["family_id"])
    return out.where("chosen").select("family_id", "adapter_id", "n", F.round("mean_regret", 6).alias("mean_regret"), F.round("accuracy", 6).alias("accuracy"))


def threshold_choice(s: SparkSession, d: str) -> DataFrame:
    """Thresholds of routing by confidence: with each, the mean regret against the parent's and the rate of wrong
    picks; of those that improve by a hundredth and route at least a tenth, the best."""
    p = _pred(s, d).where("regret IS NOT NULL").withColumns({"confidence": 1 - F.col("regret"), "hit": F.coalesce(F.col("predicted_method_id") == F.col("oracle_method_id"), F.lit(False))})
    base = p.agg(F.avg("regret").alias("base"), F.count(F.lit(1)).alias("all"))
    sweep = E.threshold_sweep(p, "confidence", F.col("hit"), [i / 10 for i in range(1, 10)]).crossJoin(base.select("all"))
    d_ = sweep.withColumns({"share": F.round(F.col("routed") / F.col("all"), 6), "accuracy": F.when(F.col("routed") > 0, F.round(F.col("hits") / F.col("routed"), 6))})
    out = G.eligible_best(d_, {"enough": F.col("share") >= 0.1, "better": F.col("accuracy") >= 0.3}, [F.desc("accuracy"), F.desc("share"), F.desc("threshold")])
    return out.select("threshold", "routed", "hits", "share", "accuracy", "failed", "passed", "chosen")


def trigger_summary(s: SparkSession, d: str) -> DataFrame:
    """Blueprints as groups of language views: largest regret, any invalid prediction, whether complete."""
    p = _pred(s, d).where("blueprint_id IS NOT NULL AND language IS NOT NULL").groupBy("blueprint_id", "language").agg(F.min_by("family_id", "prediction_id").alias("family_id"), F.max("regret").alias("regret"), F.max(~F.col("valid")).alias("invalid"))
    return O.trigger_summary(p, "blueprint_id", "language", "family_id", "regret", "invalid", 3).withColumn("most_expected", F.round("most_expected", 6))


def learning_signals(s: SparkSession, d: str) -> DataFrame:
    """Per family from the parent's and the experts' mean regret."""
    a = table(s, d, "adapters").select("adapter_id", F.col("parent_adapter_id").isNull().alias("parent"))
    m = _pred(s, d).where("regret IS NOT NULL AND family_id IS NOT NULL").join(a, "adapter_id").groupBy("family_id").agg(F.avg(F.when(F.col("parent"), F.col("regret"))).alias("a"), F.avg(F.when(~F.col("parent"), F.col("regret"))).alias("b"))
    return m.select("family_id", F.round(O.learning_signal(F.col("a"), F.col("b")), 6).alias("signal"), F.round(O.relative_improvement(F.col("a"), F.col("b")), 6).alias("improvement"))


def excess_losses(s: SparkSession, d: str) -> DataFrame:
    """Halves of each vector as token losses of two models."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    n = F.floor(F.size("embedding") / 2).cast("int")
    e = table(s, d, "embeddings").select("vec_id", O.excess_loss(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n)).alias("e"))
    return e.select("vec_id", *[F.round(f"e.{c}", 6).alias(c) for c in ("student", "teacher", "mean_excess", "mass", "positive_share", "utility")])


def shared_columns(s: SparkSession, d: str) -> DataFrame:
    """Which table each column name belongs to; null where several have it."""
    names = ["customer", "supplier", "part", "orders", "events", "documents", "predictions", "scenarios", "routing_canary"]
    rows = [(c, n) for n in names for c in table(s, d, n).columns]
    return compiler.owners(s.createDataFrame(rows, "column_name string, file string"), "column_name", "file")


def mixing_targets(s: SparkSession, d: str) -> DataFrame:
    """English characters wanted per domain beside the Chinese ones, for 60 % English: deficits and common scale."""
    x = table(s, d, "documents").where("n_chars > 0").select(code_key(F.col("lang")).alias("lang"), F.coalesce("domain", F.lit("?")).alias("domain"), "n_chars")
    en, zh = x.where("lang = 'en'"), x.where("lang IN ('zh_hant', 'zh_hans')")
    return U.compensation(en, zh, "domain", "n_chars", 0.6, {"inference_and_design": 0.5, "probability_and_bayes": 0.25, "?": 0.25})


def balanced_budgets(s: SparkSession, d: str) -> DataFrame:
    """Per domain the smallest total over the languages: what each language may give."""
    x = table(s, d, "documents").where("n_chars > 0 AND lang IS NOT NULL").select(code_key(F.col("lang")).alias("lang"), F.coalesce("domain", F.lit("?")).alias("domain"), "n_chars")
    return U.least_budget(x, "lang", ["domain"], "n_chars")


def final_order(s: SparkSession, d: str) -> DataFrame:
    """Canary prompts in the order of a digest of seed, task and language, the first thousand places: a top-k report."""
    c = table(s, d, "routing_canary").select("canary_row", F.coalesce("task_id", F.lit("")).alias("task_id"), F.coalesce(code_key(F.col("language")), F.lit("")).alias("language"))
    return U.digest_sorted(c, 11, ["task_id", "language"], ["canary_row"], 1000)


def disjoint_allocation(s: SparkSession, d: str) -> DataFrame:
    """Blueprints not in training: the first 40 by digest for development, the next 40 for the final evaluation."""
    x = table(s, d, "scenarios").select(id_key(F.col("blueprint_id")).alias("blueprint_id"), id_key(F.col("split")).alias("split")).where("blueprint_id IS NOT NULL")
    used = x.where("split = 'train'").select("blueprint_id").distinct()
    return U.allocate_disjoint(x.select("blueprint_id").distinct(), used, "blueprint_id", [("dev", 40), ("final", 40)], 5)


def curriculum(s: SparkSession, d: str) -> DataFrame:
    """Blueprints by boundary round (2, 1, 0), shuffled inside: place and round."""
    x = table(s, d, "scenarios").groupBy(id_key(F.col("blueprint_id")).alias("blueprint_id")).agg(F.max("boundary_round").alias("boundary_round")).where("blueprint_id IS NOT NULL AND boundary_round IS NOT NULL")
    return U.tiered(x, "boundary_round", "blueprint_id", 3)


def replay_interleave(s: SparkSession, d: str) -> DataFrame:
    """Four fresh blueprints, one replayed, and so on; what is left over follows."""
    x = table(s, d, "scenarios").groupBy(id_key(F.col("blueprint_id")).alias("blueprint_id")).agg(F.max((F.coalesce("source", F.lit("")).startswith("cycles/")).cast("int")).alias("fresh")).where("blueprint_id IS NOT NULL")
    return U.interleaved(x, F.col("fresh") == 1, "blueprint_id", 4, 3)


_ALL = [nearest_history, guard_choice, adapter_choice, threshold_choice, trigger_summary, learning_signals, excess_losses, shared_columns, mixing_targets, balanced_budgets, final_order, disjoint_allocation, curriculum, replay_interleave, admission_reasons, temperature_choice, complete_groups, replay_sample, importance_weights, menus, scenario_mutations, capped_picks, routed_pick, replaced_rows, paired_coverage, culprit_families, guard_metrics, promotion_gates, data_gate, role_picks, hash_picks, rank_failures, regret_quantiles, weighted_regret, method_sets, user_text, candidate_ids, bound_texts, prompt_percentages, selected_tokens, novelty_of_queries, stream_window_counts]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_P = """p AS (SELECT prediction_id, nullif(lower(trim(blueprint_id)), '') AS blueprint_id, lower(replace(trim(family_id), '-', '_')) AS family_id, domain,
  lower(replace(trim(language), '-', '_')) AS language, adapter_id, predicted_method_id, oracle_method_id, CASE WHEN isnan(normalized_regret) THEN NULL ELSE normalized_regret END AS regret, valid FROM predictions)"""
_S = f"WITH {_P}, s AS (SELECT blueprint_id, language, slug, arg_min(regret, prediction_id) AS regret, arg_min(p.family_id, prediction_id) AS family_id FROM p JOIN adapters a USING (adapter_id) WHERE blueprint_id IS NOT NULL AND language IS NOT NULL AND regret IS NOT NULL GROUP BY ALL)"


_SQ = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_NEAR = """WITH b AS (SELECT lower(replace(trim(family_id), '-', '_')) AS f, list(parameter_name ORDER BY parameter_name) AS k, list(upper_bound - lower_bound ORDER BY parameter_name) AS w FROM family_bounds GROUP BY 1),
s AS (SELECT scenario_row AS n, lower(replace(trim(family_id), '-', '_')) AS f, lower(trim(split)) AS split, list_transform(k, lambda x : CASE WHEN isnan(parameters[x]) THEN NULL ELSE parameters[x] END) AS v, w FROM scenarios JOIN b ON b.f = lower(replace(trim(family_id), '-', '_')) WHERE parameters IS NOT NULL),
far AS (SELECT a.n AS q, c.n AS r, list_transform(range(1, len(a.w) + 1), lambda i : coalesce(abs(a.v[i] - c.v[i]) / a.w[i], 1.0)) AS g FROM s a JOIN s c ON a.f = c.f AND a.n <> c.n WHERE a.n % 100 = 0 AND c.split = 'train')"""


def oracle_sql() -> dict[str, str]:
    both = "(SELECT blueprint_id, language, regret FROM s WHERE slug = '{}')"
    z = "ln((0.05 + 0.9 * (1 - regret)) / (1 - (0.05 + 0.9 * (1 - regret))))"
    return {
        "admission_reasons": f"""WITH c AS (SELECT record_id, list_filter(messages, lambda x : x.role = 'user')[1].content AS u, list_filter(messages, lambda x : x.role = 'assistant')[1].content AS a, nullif(lower(trim(metadata.split)), '') AS split, nullif(lower(replace(trim(metadata.language), '-', '_')), '') AS language FROM chat_records),
e AS (SELECT *, sha256({_SQ.replace('text', 'u')}) AS h, CASE WHEN coalesce(trim(u, ' '), '') = '' OR coalesce(trim(a, ' '), '') = '' THEN 'missing_content' WHEN len(regexp_extract_all(a, '```')) % 2 = 1 THEN 'unfinished' WHEN split IS NULL OR language IS NULL THEN 'missing_split' END AS early FROM c),
q AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY split, language, early IS NULL ORDER BY record_id) END AS k FROM e),
r AS (SELECT *, CASE WHEN k <= 400 THEN row_number() OVER (PARTITION BY h, coalesce(k <= 400, false) ORDER BY record_id) END AS copy FROM q)
SELECT coalesce(early, CASE WHEN k > 400 THEN 'quota' WHEN copy > 1 THEN 'duplicate' WHEN h IN (SELECT sha256({_SQ}) FROM routing_canary WHERE text IS NOT NULL) THEN 'benchmark_overlap' WHEN length(u) + length(a) > 3000 THEN 'too_long' ELSE 'admitted' END) AS reason, count(*) AS n FROM r GROUP BY 1""",
        "novelty_of_queries": f"{_NEAR} SELECT q AS scenario_row, round(min(sqrt(list_sum(list_transform(g, lambda x : x * x)) / len(g))), 6) AS novelty FROM far GROUP BY q",
        "nearest_history": f"{_NEAR} SELECT q AS scenario_row, round(min(list_max(g)), 6) AS distance, arg_min(r, struct_pack(d := list_max(g), r := r)) AS nearest FROM far GROUP BY q",
        "guard_choice": f"WITH {_P}, g AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 20) x(i)), d AS (SELECT domain, NOT valid AS bad, regret AS s FROM p WHERE valid IS NOT NULL AND regret IS NOT NULL), m AS (SELECT t, domain, count(*) FILTER (bad) AS p, count(*) FILTER (NOT bad) AS n, count(*) FILTER (bad AND s >= t) AS h, count(*) FILTER (NOT bad AND s < t) AS q FROM d, g GROUP BY ALL), r AS (SELECT t AS threshold, round(sum(h) / sum(p), 6) AS sensitivity, round(sum(q) / sum(n), 6) AS specificity, round(min(CASE WHEN p > 0 THEN h / p END), 6) AS min_sensitivity, round(min(CASE WHEN n > 0 THEN q / n END), 6) AS min_specificity FROM m GROUP BY t), f AS (SELECT *, concat_ws(',', CASE WHEN coalesce(sensitivity < 0.3, true) THEN 'sensitivity' END, CASE WHEN coalesce(specificity < 0.3, true) THEN 'specificity' END, CASE WHEN coalesce(min_specificity < 0.2, true) THEN 'worst' END) AS failed FROM r) SELECT *, failed = '' AS passed, failed = '' AND row_number() OVER (ORDER BY failed = '' DESC, sensitivity DESC, specificity DESC, threshold) = 1 AS chosen FROM f",
        "adapter_choice": f"WITH {_P}, x AS (SELECT * FROM p WHERE regret IS NOT NULL AND family_id IS NOT NULL), w AS (SELECT family_id, round(avg(regret), 9) AS w FROM x GROUP BY 1), m AS (SELECT family_id, adapter_id, count(*) AS n, round(avg(regret), 9) AS r, round(avg(coalesce((predicted_method_id = oracle_method_id)::INT, 0)), 9) AS a, round(avg((NOT valid)::INT), 9) AS i FROM x GROUP BY ALL) SELECT family_id, adapter_id, n, round(r, 6) AS mean_regret, round(a, 6) AS accuracy FROM m JOIN w USING (family_id) WHERE n >= 5 AND r <= w + 0.02 AND i <= 0.5 QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY r, a DESC, adapter_id) = 1",
        "threshold_choice": f"WITH {_P}, x AS (SELECT 1 - regret AS c, coalesce(predicted_method_id = oracle_method_id, false) AS hit FROM p WHERE regret IS NOT NULL), g AS (SELECT i / 10.0::DOUBLE AS threshold FROM range(1, 10) x(i)), m AS (SELECT threshold, count(*) FILTER (c >= threshold) AS routed, count(*) FILTER (c >= threshold AND hit) AS hits, round(count(*) FILTER (c >= threshold) / count(*), 6) AS share FROM x, g GROUP BY 1), a AS (SELECT *, CASE WHEN routed > 0 THEN round(hits / routed, 6) END AS accuracy FROM m), f AS (SELECT *, concat_ws(',', CASE WHEN share < 0.1 THEN 'enough' END, CASE WHEN coalesce(accuracy < 0.3, true) THEN 'better' END) AS failed FROM a) SELECT *, failed = '' AS passed, failed = '' AND row_number() OVER (ORDER BY failed = '' DESC, accuracy DESC, share DESC, threshold DESC) = 1 AS chosen FROM f",
        "trigger_summary": f"WITH {_P}, v AS (SELECT blueprint_id, language, arg_min(family_id, prediction_id) AS f, max(regret) AS r, bool_or(NOT valid) AS i FROM p WHERE blueprint_id IS NOT NULL AND language IS NOT NULL GROUP BY ALL) SELECT blueprint_id, count(DISTINCT language) AS n_views, count(DISTINCT f) AS n_families, round(max(r), 6) AS most_expected, bool_or(i) AS any_invalid, count(*) = 3 AND count(DISTINCT language) = 3 AND count(DISTINCT f) = 1 AS complete FROM v GROUP BY 1",
        "learning_signals": f"WITH {_P}, m AS (SELECT family_id, avg(regret) FILTER (parent_adapter_id IS NULL) AS a, avg(regret) FILTER (parent_adapter_id IS NOT NULL) AS b FROM (SELECT p.family_id, regret, parent_adapter_id FROM p JOIN adapters USING (adapter_id)) WHERE regret IS NOT NULL AND family_id IS NOT NULL GROUP BY 1), g AS (SELECT *, (a - b) / greatest(0.05, a) / 0.25 AS x FROM m) SELECT family_id, round(0.5 + 0.25 * (exp(x) - exp(-x)) / (exp(x) + exp(-x)), 6) AS signal, round(CASE WHEN a <> 0 THEN (a - b) / a ELSE 0 END, 6) AS improvement FROM g",
        "excess_losses": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : abs(x::DOUBLE)) AS v, len(embedding) // 2 AS n FROM embeddings), h AS (SELECT vec_id, n, v[1:n] AS s, v[n + 1:2 * n] AS t FROM v), d AS (SELECT *, list_transform(list_zip(s, t), lambda x : x[1] - x[2]) AS d FROM h), m AS (SELECT vec_id, list_sum(s) / n AS student, list_sum(t) / n AS teacher, list_sum(d) / n AS mean_excess, list_sum(list_transform(d, lambda x : greatest(x, 0))) / n AS mass, len(list_filter(d, lambda x : x > 0)) / n AS positive_share FROM d) SELECT vec_id, round(student, 6) AS student, round(teacher, 6) AS teacher, round(mean_excess, 6) AS mean_excess, round(mass, 6) AS mass, round(positive_share, 6) AS positive_share, round(mass / (1 + teacher) + 0.02 * student, 6) AS utility FROM m",
        "shared_columns": "SELECT column_name, CASE WHEN count(*) = 1 THEN min(table_name) END AS file, count(*) AS n_files FROM information_schema.columns WHERE table_name IN ('customer', 'supplier', 'part', 'orders', 'events', 'documents', 'predictions', 'scenarios', 'routing_canary') GROUP BY 1",
        "mixing_targets": "WITH x AS (SELECT lower(replace(trim(lang), '-', '_')) AS l, coalesce(domain, '?') AS d, n_chars AS n FROM documents WHERE n_chars > 0), w AS (SELECT * FROM (VALUES ('inference_and_design', 0.5), ('probability_and_bayes', 0.25), ('?', 0.25)) v(domain, s)), t AS (SELECT round(sum(n) / (1 - 0.6)) AS t FROM x WHERE l IN ('zh_hant', 'zh_hans')), m AS (SELECT domain, greatest(0, round(t * s) - coalesce((SELECT sum(n) FROM x WHERE l IN ('zh_hant', 'zh_hans') AND d = domain), 0)) AS want, coalesce((SELECT sum(n) FROM x WHERE l = 'en' AND d = domain), 0) AS have FROM w, t), k AS (SELECT least(1, min(have / want) FILTER (want > 0)) AS k FROM m) SELECT domain, want::BIGINT AS wanted, have::BIGINT AS available, round(k, 6) AS scale, round(want * k)::BIGINT AS budget FROM m, k",
        "balanced_budgets": "WITH x AS (SELECT lower(replace(trim(lang), '-', '_')) AS lang, coalesce(domain, '?') AS domain, sum(n_chars) AS n FROM documents WHERE n_chars > 0 AND lang IS NOT NULL GROUP BY ALL), l AS (SELECT count(DISTINCT lang) AS k FROM x) SELECT domain, CASE WHEN count(*) = any_value(k) THEN min(n)::BIGINT ELSE 0 END AS budget, count(*) AS n_slices FROM x, l GROUP BY domain",
        "final_order": "SELECT canary_row, task_id, language, row_number() OVER (ORDER BY h, canary_row)::INT AS place FROM (SELECT canary_row, coalesce(task_id, '') AS task_id, coalesce(nullif(lower(replace(trim(language), '-', '_')), ''), '') AS language, sha256('11:' || coalesce(task_id, '') || ':' || coalesce(nullif(lower(replace(trim(language), '-', '_')), ''), '')) AS h FROM routing_canary) ORDER BY h, canary_row LIMIT 1000",
        "disjoint_allocation": "WITH x AS (SELECT DISTINCT lower(trim(blueprint_id)) AS b FROM scenarios WHERE trim(blueprint_id) <> ''), u AS (SELECT DISTINCT lower(trim(blueprint_id)) AS b FROM scenarios WHERE lower(trim(split)) = 'train'), k AS (SELECT b, row_number() OVER (ORDER BY sha256('5:' || b), b) AS k FROM x WHERE NOT EXISTS (FROM u WHERE u.b = x.b)) SELECT b AS blueprint_id, CASE WHEN k <= 40 THEN 'dev' ELSE 'final' END AS part, k::INT AS place FROM k WHERE k <= 80",
        "curriculum": "WITH x AS (SELECT lower(trim(blueprint_id)) AS b, max(boundary_round) AS r FROM scenarios WHERE trim(blueprint_id) <> '' GROUP BY 1 HAVING max(boundary_round) IS NOT NULL) SELECT b AS blueprint_id, r AS boundary_round, row_number() OVER (ORDER BY r DESC, ('0x' || substr(sha256('3:' || b), 1, 15))::BIGINT, b) AS place FROM x",
        "replay_interleave": "WITH x AS (SELECT lower(trim(blueprint_id)) AS b, bool_or(coalesce(source, '') LIKE 'cycles/%') AS f FROM scenarios WHERE trim(blueprint_id) <> '' GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ('0x' || substr(sha256('3:' || b), 1, 15))::BIGINT, b) - 1 AS k FROM x), t AS (SELECT b, f, CASE WHEN f THEN k // 4 ELSE k END AS turn, CASE WHEN f THEN k % 4 ELSE 4 END AS slot FROM k) SELECT b AS blueprint_id, f AS fresh, row_number() OVER (ORDER BY turn, slot) AS place FROM t",
        "temperature_choice": f"WITH {_P}, x AS (SELECT {z} AS z, (predicted_method_id = oracle_method_id)::INT AS hit FROM p WHERE regret IS NOT NULL AND predicted_method_id IS NOT NULL AND oracle_method_id IS NOT NULL), t AS (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0])::DOUBLE AS t), m AS (SELECT t AS temperature, round(avg(-(hit * ln(1 / (1 + exp(-z / t))) + (1 - hit) * ln(1 - 1 / (1 + exp(-z / t))))), 6) AS nll, round(avg(((z >= 0) = (hit = 1))::INT), 6) AS accuracy, count(*) AS n FROM x, t GROUP BY t) SELECT *, row_number() OVER (ORDER BY nll, accuracy DESC, temperature) = 1 AS chosen FROM m",
        "complete_groups": f"WITH {_P} SELECT blueprint_id, count(*) = 3 AND list_sort(list(DISTINCT language)) = ['en', 'zh_hans', 'zh_hant'] AS complete, count(*) AS n FROM p WHERE blueprint_id IS NOT NULL AND language IS NOT NULL GROUP BY 1",
        "importance_weights": f"WITH {_P}, g AS (SELECT language, count(*) AS n FROM p WHERE language IS NOT NULL GROUP BY 1) SELECT language, n, round(CASE language WHEN 'en' THEN 0.5 WHEN 'zh_hant' THEN 0.25 WHEN 'zh_hans' THEN 0.25 ELSE 0 END / (n / sum(n) OVER ()), 6) AS weight FROM g",
        "routed_pick": f"{_S} SELECT blueprint_id, language, round(coalesce(e.regret, a.regret), 6) AS regret FROM {both.format('expert')} e FULL JOIN {both.format('parent')} a USING (blueprint_id, language)",
        "replaced_rows": f"{_S}, r AS (SELECT * FROM s WHERE slug = 'repair' UNION ALL SELECT * FROM s a WHERE slug = 'parent' AND NOT EXISTS (FROM s b WHERE b.slug = 'repair' AND b.blueprint_id = a.blueprint_id AND b.language = a.language)) SELECT family_id, count(*) AS n, round(avg(regret), 6) AS mean_regret FROM r GROUP BY 1",
        "paired_coverage": f"{_S} SELECT language, count(*) AS n, count(a.regret - e.regret) AS n_paired, round(avg(a.regret - e.regret), 6) AS mean_difference FROM {both.format('parent')} a FULL JOIN {both.format('expert')} e USING (blueprint_id, language) GROUP BY 1",
        "culprit_families": f"{_S}, x AS (SELECT a.family_id, e.regret - a.regret AS d FROM s a JOIN s e USING (blueprint_id, language, family_id) WHERE a.slug = 'parent' AND e.slug = 'expert'), g AS (SELECT family_id, count(*) AS n, sum(d) AS d FROM x GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS tn, sum(d) OVER () AS td FROM g) SELECT family_id, n, round(round(d / n, 9), 6) AS mean_change, round(round(d / tn, 9), 6) AS contribution, CASE WHEN tn > n THEN round(round((td - d) / (tn - n), 9), 6) END AS change_without FROM t",
        "guard_metrics": f"WITH {_P} SELECT family_id, language, count(*) AS n, round(avg((regret > 0.8)::INT) FILTER (NOT valid), 6) AS sensitivity, round(avg((regret <= 0.8)::INT) FILTER (valid), 6) AS specificity FROM p WHERE valid IS NOT NULL AND regret IS NOT NULL GROUP BY ALL",
        "promotion_gates": f"WITH {_P}, m AS (SELECT adapter_id, count(*) AS n, count(*) >= 50 AS enough_rows, coalesce(avg(regret) <= 0.45, false) AS regret, coalesce(avg((predicted_method_id = oracle_method_id)::INT) >= 0.4, false) AS accuracy, coalesce(avg((NOT valid)::INT) <= 0.25, false) AS invalid FROM p GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN NOT enough_rows THEN 'enough_rows' END, CASE WHEN NOT regret THEN 'regret' END, CASE WHEN NOT accuracy THEN 'accuracy' END, CASE WHEN NOT invalid THEN 'invalid' END) AS failed, enough_rows AND regret AND accuracy AND invalid AS passed FROM m",
        "data_gate": """WITH c AS (SELECT coalesce(len(messages) > 1, false) AS a, coalesce(messages[-1].role = 'assistant', false) AS b, coalesce(lower(trim(metadata.split)) IN ('train', 'valid', 'test'), false) AS c,
  coalesce(lower(replace(trim(metadata.language), '-', '_')) IN ('en', 'zh_hant', 'zh_hans'), false) AS d, metadata.source_repo IS NOT NULL AS e, coalesce(metadata.token_count > 0, false) AS f FROM chat_records),
s AS (SELECT count(*) AS n, [count(*) FILTER (NOT a), count(*) FILTER (NOT b), count(*) FILTER (NOT c), count(*) FILTER (NOT d), count(*) FILTER (NOT e), count(*) FILTER (NOT f)] AS k FROM c)
SELECT unnest(['has_messages', 'ends_with_assistant', 'known_split', 'known_language', 'has_repo', 'has_tokens']) AS check_name, n AS n_rows, unnest(k) AS n_failed FROM s""",
        "role_picks": f"WITH {_P}, h AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY valid, regret DESC, prediction_id) AS h FROM p WHERE regret IS NOT NULL AND valid IS NOT NULL), e AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY valid DESC, regret, prediction_id) AS e FROM h WHERE h > 10) SELECT prediction_id, family_id, 'repair' AS role FROM h WHERE h <= 10 UNION ALL SELECT prediction_id, family_id, 'anchor' FROM e WHERE e <= 10",
        "hash_picks": "SELECT scenario_row, family_id, pick FROM (SELECT scenario_row, lower(replace(trim(family_id), '-', '_')) AS family_id, row_number() OVER (PARTITION BY lower(replace(trim(family_id), '-', '_')) ORDER BY sha256('42:' || scenario_row), scenario_row)::INT AS pick FROM scenarios) WHERE pick <= 5",
        "rank_failures": f"WITH {_P} SELECT prediction_id, round(regret, 6) AS regret FROM p WHERE NOT valid AND regret IS NOT NULL ORDER BY p.regret DESC, prediction_id LIMIT 100",
        "regret_quantiles": f"WITH {_P}, q AS (SELECT family_id, quantile_cont(regret, [0.025, 0.5, 0.975]) AS q FROM p GROUP BY 1) SELECT family_id, round(q[1], 6) AS low, round(q[2], 6) AS median, round(q[3], 6) AS high FROM q",
        "weighted_regret": f"WITH {_P}, w AS (SELECT domain, regret AS y, CASE WHEN valid THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM p WHERE regret IS NOT NULL) SELECT domain, round(sum(w * y) / sum(w), 6) AS weighted_mean, round(pow(sum(w), 2) / sum(w * w), 4) AS effective_size FROM w GROUP BY 1",
        "method_sets": "WITH a AS (SELECT DISTINCT predicted_method_id AS m FROM predictions WHERE predicted_method_id IS NOT NULL), b AS (SELECT DISTINCT oracle_method_id AS m FROM predictions WHERE oracle_method_id IS NOT NULL) SELECT m AS method_id, 'union' AS part FROM (FROM a UNION FROM b) UNION ALL SELECT m, 'both' FROM (FROM a INTERSECT FROM b) UNION ALL SELECT m, 'only_predicted' FROM (FROM a EXCEPT FROM b)",
        "user_text": "WITH u AS (SELECT record_id, list_transform(list_filter(messages, lambda x : x.role = 'user'), lambda x : x.content) AS u FROM chat_records) SELECT record_id, md5(array_to_string(u, chr(10))) AS joined, md5(u[-1]) AS last, len(u)::INT AS n_user FROM u",
        "candidate_ids": "SELECT doc_id, substr(sha256(coalesce(source, '') || '|' || text), 1, 24) AS candidate_id FROM documents WHERE text IS NOT NULL",
        "bound_texts": "SELECT family_id, parameter_name, " + ", ".join(f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.3f', {c}), '0+$', ''), '[.]$', '') END AS {n}" for c, n in (("lower_bound", "low"), ("upper_bound", "high"))) + " FROM family_bounds",
        "selected_tokens": "WITH v AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x : x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, n, unnest(e) AS d, unnest(range(n::BIGINT)) AS i FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, i) AS k, count(*) OVER (PARTITION BY vec_id) AS good FROM u WHERE d > 0), t AS (SELECT vec_id, i FROM g WHERE k <= ceil(good * 0.25) UNION SELECT vec_id, i FROM u WHERE i >= n - 2) SELECT vec_id, count(*)::INT AS n_kept, min(i)::INT AS first_kept FROM t GROUP BY 1",
        "prompt_percentages": "SELECT canary_row, p AS percent FROM (SELECT canary_row, try_cast(nullif(regexp_extract(text, '([0-9]+(?:[.][0-9]+)?)%', 1), '') AS DOUBLE) AS p FROM routing_canary) WHERE p IS NOT NULL",
        "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
