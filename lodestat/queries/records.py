"""Preparation and scoring of records over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.keys import code_key, id_key
from lodestat.operators import records as P
from lodestat.queries.gates import _P, _pred
from lodestat.sources.tables import table


def verified_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers of a record as generations: correct if not blank, complete if closed, the shortest wins."""
    a = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    c = table(s, d, "chat_records").select("record_id", a.alias("g"))
    ok = F.transform("g", lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False)))
    whole = F.transform("g", lambda x: F.coalesce(F.regexp_count(x, F.lit("```")) % 2 == 0, F.lit(False)))
    v = P.verified_answer(F.col("g"), ok, whole, F.array().cast("array<string>"), F.lit(None).cast("string"))
    return c.select("record_id", F.md5(v).alias("digest"), F.length(v).alias("n_chars"))


def chosen_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Every prediction beside the mean regret of its method in its family; methods no valid prediction has count as 1."""
    p = _pred(s, d).where("family_id IS NOT NULL")
    known = p.where("valid AND regret IS NOT NULL AND predicted_method_id IS NOT NULL").groupBy("family_id", "predicted_method_id").agg(F.round(F.avg("regret"), 9).alias("regret")).withColumn("valid", F.lit(True))
    out = P.candidate_outcome(p.select("prediction_id", "family_id", "predicted_method_id"), known, ["family_id"], "predicted_method_id", "regret", "valid")
    return out.select("prediction_id", F.round("regret", 6).alias("regret"), "valid")


def prediction_parents(s: SparkSession, d: str) -> DataFrame:
    """Predictions beside the scenario of their blueprint: why one can't be used, counted."""
    x = table(s, d, "scenarios").select(id_key(F.col("blueprint_id")).alias("blueprint_id"), id_key(F.col("split")).alias("split"), code_key(F.col("family_id")).alias("parent_family")).where("blueprint_id IS NOT NULL")
    one = x.groupBy("blueprint_id").agg(F.min("split").alias("split"), F.min("parent_family").alias("parent_family"))
    p = _pred(s, d).select("prediction_id", "blueprint_id", "family_id")
    j = P.with_parent(p, one, "blueprint_id", [("other_family", F.col("family_id") == F.col("parent_family")), ("no_split", F.col("split").isNotNull())])
    return j.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def script_checks(s: SparkSession, d: str) -> DataFrame:
    """Documents by language and whether they are in its script."""
    x = table(s, d, "documents").where("text IS NOT NULL").select(code_key(F.col("lang")).alias("lang"), P.has_script(F.col("text"), F.col("lang")).alias("ok"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_in_script"))


def english_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents by label and whether they read as English: the labels teach, all documents are judged."""
    x = table(s, d, "documents").select("doc_id", "text", code_key(F.col("lang")).alias("lang"))
    kept = P.language_rows(x, x, "doc_id", "text", "lang", "en")
    return x.join(kept, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("n_english"))


def method_scores(s: SparkSession, d: str) -> DataFrame:
    """Predicted against oracle methods, their words as the columns, per domain."""
    w = lambda c: F.split(F.col(c), "_")
    p = _pred(s, d).where("predicted_method_id IS NOT NULL AND oracle_method_id IS NOT NULL").withColumns({"w": w("oracle_method_id"), "g": w("predicted_method_id")})
    return P.set_scores(p, ["domain"], "w", "g", "oracle_method_id", "predicted_method_id")


def regret_as_p(s: SparkSession, d: str) -> DataFrame:
    """Regrets of the parent and of experts on the same blueprint and language, read as two p values."""
    a = table(s, d, "adapters").select("adapter_id", F.col("parent_adapter_id").isNull().alias("parent"))
    p = _pred(s, d).where("regret > 0 AND blueprint_id IS NOT NULL AND language IS NOT NULL").join(a, "adapter_id")
    m = p.groupBy("blueprint_id", "language").agg(F.round(F.avg(F.when(F.col("parent"), F.col("regret"))), 9).alias("wanted"), F.round(F.avg(F.when(~F.col("parent"), F.col("regret"))), 9).alias("given"))
    return P.p_value_scores(m.where("wanted IS NOT NULL AND given IS NOT NULL"), ["language"], "wanted", "given", 0.3).drop("strict")


def bucket_requirements(s: SparkSession, d: str) -> DataFrame:
    """Canary rows with text per language and family against the minimum of the targets."""
    c = table(s, d, "routing_canary").where("text IS NOT NULL").select(code_key(F.col("language")).alias("language"), code_key(F.col("family_id")).alias("family_id"))
    t = table(s, d, "sample_targets").select(code_key(F.col("language")).alias("language"), code_key(F.col("family_id")).alias("family_id"), "min_rows")
    return P.requirements_met(c, t, ["language", "family_id"], "min_rows")


def easy_and_hard(s: SparkSession, d: str) -> DataFrame:
    """Per family five predictions with a regret above a half and five others: the picks are the feature."""
    p = _pred(s, d).where("regret IS NOT NULL").select("prediction_id", "family_id", "regret")
    return P.stratified_halves(p, "family_id", F.col("regret") > 0.5, "prediction_id", 5, 9).select("prediction_id", "family_id", "half", "place")


def early_stopping(s: SparkSession, d: str) -> DataFrame:
    """Mean regret per family over boundary rounds as a history."""
    p = _pred(s, d).where("regret IS NOT NULL AND family_id IS NOT NULL AND blueprint_id IS NOT NULL")
    x = table(s, d, "scenarios").select(id_key(F.col("blueprint_id")).alias("blueprint_id"), "boundary_round").where("blueprint_id IS NOT NULL AND boundary_round IS NOT NULL").groupBy("blueprint_id").agg(F.max("boundary_round").alias("step"))
    h = p.join(x, "blueprint_id").groupBy("family_id", "step").agg(F.round(F.avg("regret"), 9).alias("loss"))
    return P.early_stops(h, ["family_id"], "step", "loss", 1).withColumn("best", F.round("best", 6))


def weight_mass(s: SparkSession, d: str) -> DataFrame:
    """Weights per language and domain of the documents: mass and characters, singly and together."""
    x = table(s, d, "documents").where("n_chars > 0").select(code_key(F.col("lang")).alias("lang"), "domain", "n_chars", F.when(code_key(F.col("lang")) == "en", 0.5).otherwise(1.0).alias("w"))
    return x.cube("lang", "domain").agg(F.grouping_id().alias("level"), F.round(F.sum("w"), 4).alias("mass"), F.sum("n_chars").alias("chars"))


_ALL = [verified_answers, chosen_outcomes, prediction_parents, script_checks, english_documents, method_scores, regret_as_p, bucket_requirements, easy_and_hard, early_stopping, weight_mass]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    hant, hans = P.variant_letters()
    lang = "nullif(lower(replace(trim(lang), '-', '_')), '')"
    return {
        "verified_answers": "WITH a AS (SELECT record_id, list_transform(list_filter(messages, lambda x : x.role = 'assistant'), lambda x : x.content) AS g FROM chat_records), k AS (SELECT record_id, list_transform(list_filter(g, lambda x : coalesce(length(trim(x, ' ')) > 0, false) AND len(regexp_extract_all(x, '```')) % 2 = 0), lambda x : trim(x, ' ')) AS k FROM a), m AS (SELECT record_id, list_filter(k, lambda x : length(x) = list_min(list_transform(k, lambda y : length(y))))[1] AS v FROM k) SELECT record_id, md5(v) AS digest, length(v)::INT AS n_chars FROM m",
        "chosen_outcomes": f"WITH {_P}, k AS (SELECT family_id, predicted_method_id, round(avg(regret), 9) AS r FROM p WHERE valid AND regret IS NOT NULL AND predicted_method_id IS NOT NULL AND family_id IS NOT NULL GROUP BY ALL) SELECT prediction_id, round(coalesce(CASE WHEN predicted_method_id <> 'needs_clarification' THEN r END, 1), 6) AS regret, r IS NOT NULL AND predicted_method_id <> 'needs_clarification' AS valid FROM p LEFT JOIN k USING (family_id, predicted_method_id) WHERE family_id IS NOT NULL",
        "prediction_parents": f"WITH {_P}, x AS (SELECT lower(trim(blueprint_id)) AS b, min(nullif(lower(trim(split)), '')) AS split, min(nullif(lower(replace(trim(family_id), '-', '_')), '')) AS f FROM scenarios WHERE trim(blueprint_id) <> '' GROUP BY 1) SELECT CASE WHEN x.b IS NULL THEN 'missing_parent' WHEN NOT coalesce(p.family_id = x.f, false) THEN 'other_family' WHEN x.split IS NULL THEN 'no_split' ELSE 'usable' END AS reason, count(*) AS n FROM p LEFT JOIN x ON x.b = p.blueprint_id GROUP BY 1",
        "script_checks": f"SELECT {lang} AS lang, count(*) AS n, count(*) FILTER (length(regexp_replace(text, '[^㐀-䶿一-鿿]', '', 'g')) >= 8 AND CASE lower(replace(lang, '-', '_')) WHEN 'zh_hant' THEN regexp_matches(text, '[{hant}]') WHEN 'zh_hans' THEN regexp_matches(text, '[{hans}]') ELSE true END) AS n_in_script FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "method_scores": f"WITH {_P}, w AS (SELECT domain, predicted_method_id = oracle_method_id AS m, list_distinct(string_split(oracle_method_id, '_')) AS a, list_distinct(string_split(predicted_method_id, '_')) AS b FROM p WHERE predicted_method_id IS NOT NULL AND oracle_method_id IS NOT NULL) SELECT domain, count(*) AS n, round(avg(m::INT), 6) AS method_accuracy, round(avg((list_sort(a) = list_sort(b))::INT), 6) AS column_accuracy, round(avg((m AND list_sort(a) = list_sort(b))::INT), 6) AS exact, round(avg(len(list_intersect(a, b)) / len(a)), 6) AS recall FROM w GROUP BY 1",
        "regret_as_p": f"WITH {_P}, m AS (SELECT blueprint_id, language, round(avg(regret) FILTER (parent_adapter_id IS NULL), 9) AS w, round(avg(regret) FILTER (parent_adapter_id IS NOT NULL), 9) AS g FROM p JOIN (SELECT adapter_id, parent_adapter_id FROM adapters) USING (adapter_id) WHERE regret > 0 AND blueprint_id IS NOT NULL AND language IS NOT NULL GROUP BY ALL) SELECT language, count(*) AS n, round(avg(((w < 0.3) = (g < 0.3))::INT), 6) AS raw FROM m WHERE w IS NOT NULL AND g IS NOT NULL GROUP BY 1",
        "bucket_requirements": "WITH c AS (SELECT lower(replace(trim(language), '-', '_')) AS l, lower(replace(trim(family_id), '-', '_')) AS f, count(*) AS n FROM routing_canary WHERE text IS NOT NULL GROUP BY ALL) SELECT lower(replace(trim(language), '-', '_')) AS language, lower(replace(trim(family_id), '-', '_')) AS family_id, min_rows, coalesce(n, 0) AS done, coalesce(n, 0) >= min_rows AS met FROM sample_targets LEFT JOIN c ON c.l = lower(replace(trim(language), '-', '_')) AND c.f = lower(replace(trim(family_id), '-', '_'))",
        "easy_and_hard": f"WITH {_P}, h AS (SELECT prediction_id, family_id, CASE WHEN regret > 0.5 THEN 'hard' ELSE 'easy' END AS half FROM p WHERE regret IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY family_id, half ORDER BY ('0x' || substr(sha256('9:' || prediction_id), 1, 15))::BIGINT, prediction_id) AS place FROM h) SELECT * FROM k WHERE place <= 5",
        "early_stopping": f"WITH {_P}, x AS (SELECT lower(trim(blueprint_id)) AS b, max(boundary_round) AS step FROM scenarios WHERE trim(blueprint_id) <> '' AND boundary_round IS NOT NULL GROUP BY 1), h AS (SELECT family_id, step, round(avg(regret), 9) AS v FROM p JOIN x ON x.b = p.blueprint_id WHERE regret IS NOT NULL AND family_id IS NOT NULL GROUP BY ALL), g AS (SELECT *, row_number() OVER w AS k, coalesce(v < min(v) OVER (PARTITION BY family_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM h WINDOW w AS (PARTITION BY family_id ORDER BY step)), l AS (SELECT *, max(CASE WHEN gain THEN k END) OVER (PARTITION BY family_id ORDER BY step) AS last FROM g) SELECT family_id, arg_min(step, row(v, step)) AS best_step, round(min(v), 6) AS best, min(CASE WHEN k - last >= 1 THEN step END) AS stop_step FROM l GROUP BY 1",
        "weight_mass": f"WITH x AS (SELECT {lang} AS lang, domain, n_chars, CASE WHEN {lang} = 'en' THEN 0.5 ELSE 1.0 END AS w FROM documents WHERE n_chars > 0) SELECT grouping(lang, domain) AS level, lang, domain, round(sum(w)::DOUBLE, 4) AS mass, sum(n_chars)::BIGINT AS chars FROM x GROUP BY CUBE (lang, domain)",
    }
