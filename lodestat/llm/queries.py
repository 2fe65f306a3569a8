"""Named queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.keys import code_key, id_key
from lodestat.llm import containers, lookalike, mix, mojibake, overlap, pairs, sample, segments, splits, tokens
from lodestat.session import cut, spread
from lodestat.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_CATS = ["language", "family_id"]


def _counted(df: DataFrame, text: str = "text") -> DataFrame:
    return tokens.with_token_counts(spread(df).withColumn("chars", F.coalesce(F.length(text), F.lit(0))), text, merges="merge_tokens")


def p1_token_budget(s: SparkSession, d: str) -> DataFrame:
    """Totals per source (repo), language and domain of documents and chat messages, per language
    and family of canary prompts; level says which table a line belongs to."""
    docs = _counted(table(s, d, "documents").select(id_key(F.col("source")).alias("source"), code_key(F.col("lang")).alias("language"), id_key(F.col("domain")).alias("domain"), "text"))
    m = F.col("metadata")
    chat = table(s, d, "chat_records").select(id_key(m["source_repo"]).alias("source"), code_key(m["language"]).alias("language"), id_key(m["domain"]).alias("domain"), F.explode("messages").alias("message"))
    chat = _counted(chat.select("source", "language", "domain", F.col("message.content").alias("text")))
    canary = _counted(table(s, d, "routing_canary").select(code_key(F.col("language")).alias("language"), code_key(F.col("family_id")).alias("family_id"), "text"))
    cols = ["table_name", "source", "language", "domain", "family_id", "n_texts", "n_with_text", "chars", "tokens", "merge_tokens"]
    none = F.lit(None).cast("string")
    parts = [
        tokens.budget(docs, ["source", "language", "domain"]).withColumns({"table_name": F.lit("documents"), "family_id": none}),
        tokens.budget(chat, ["source", "language", "domain"]).withColumns({"table_name": F.lit("chat_records"), "family_id": none}),
        tokens.budget(canary, ["language", "family_id"]).withColumns({"table_name": F.lit("routing_canary"), "source": none, "domain": none}),
    ]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


def p1_documents(s: SparkSession, d: str) -> DataFrame:
    return _counted(table(s, d, "documents").select("doc_id", "text"))


def p1_messages(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chat_records").select("record_id", F.posexplode("messages").alias("message_pos", "message"))
    return _counted(m.select("record_id", "message_pos", F.col("message.role").alias("role"), F.col("message.content").alias("text")))


def _sized(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    return cut(tokens.with_token_counts(spread(docs), "text", longest=None, merges="n_tokens"))


def p8_containers(s: SparkSession, d: str) -> DataFrame:
    sized = _sized(s, d)
    parts = [containers.fill_containers(sized, "doc_id", "n_tokens", r["container_kind"], r["capacity_tokens"]) for r in table(s, d, "container_specs").orderBy("container_kind").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p8_report(s: SparkSession, d: str) -> DataFrame:
    return containers.container_report(p8_containers(s, d), table(s, d, "container_specs"))


def p9_copies(s: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(_sized(s, d), table(s, d, "mix_targets"), "doc_id", "source", "n_tokens")


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(p9_copies(s, d), table(s, d, "mix_targets"))


def _groups(s: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(s, d, "scenarios").select("scenario_row", "blueprint_id", "author_id", "split", "search")).select("scenario_row", "group_row", "split")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return splits.broken_groups(cut(_groups(s, d)))


def p2_assigned(s: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(cut(_groups(s, d)), splits.targets_of(s, table(s, d, "split_targets")))


def p2_shares(s: SparkSession, d: str) -> DataFrame:
    """Rows and groups per new split beside the target."""
    a = p2_assigned(s, d).groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_row").alias("n_groups"))
    total = a.agg(F.sum("n_rows").alias("total"))
    return a.crossJoin(total).join(table(s, d, "split_targets"), "split", "left").select("split", "n_rows", "n_groups", "target_share", (F.col("n_rows") / F.col("total")).alias("share"))


def _looks(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "routing_canary").select(F.lit("routing_canary").alias("table_name"), F.col("canary_row").alias("key"), "text")
    b = table(s, d, "chat_records").select(F.lit("chat_records").alias("table_name"), F.col("record_id").alias("key"), F.expr("try_element_at(filter(messages, m -> m.role = 'user'), 1).content").alias("text"))
    return cut(lookalike.look_classes(spread(a).unionByName(spread(b)), "text", "key", "table_name"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(_looks(s, d), "key", ["table_name"])


def p3_groups(s: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_groups(_looks(s, d), "key", ["table_name"])


def p3_common_forms(s: SparkSession, d: str) -> DataFrame:
    """Canary texts and the contents of all chat messages in the common form."""
    a = lookalike.common_form(table(s, d, "routing_canary").select(F.lit("routing_canary").alias("table_name"), F.col("canary_row").alias("key"), F.lit(0).alias("message_pos"), "text"), "text")
    m = table(s, d, "chat_records").select("record_id", F.posexplode("messages").alias("message_pos", "message"))
    b = lookalike.common_form(m.select(F.lit("chat_records").alias("table_name"), F.col("record_id").alias("key"), "message_pos", F.col("message.content").alias("text")), "text")
    return a.unionByName(b).select("table_name", "key", "message_pos", "common_form", (~F.col("text").eqNullSafe(F.col("common_form"))).alias("changed"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    records = spread(table(s, d, "chat_records").select("record_id", "messages"))
    return pairs.defective_pairs(records, cut(pairs.judged_pairs(records, "record_id")), "record_id")


def p5_counts(s: SparkSession, d: str) -> DataFrame:
    """Defects per repo and language of the record."""
    records = table(s, d, "chat_records")
    by = records.select("record_id", id_key(F.col("metadata.source_repo")).alias("source_repo"), code_key(F.col("metadata.language")).alias("language"))
    return p5_found(s, d).join(by, "record_id").groupBy("source_repo", "language", "defect").agg(F.count(F.lit(1)).alias("n"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    v = overlap.vectors(table(s, d, "scenarios"), table(s, d, "family_bounds"))
    return overlap.row_pairs(*overlap.near_pairs(v))


def p6_report(s: SparkSession, d: str) -> DataFrame:
    v = overlap.vectors(table(s, d, "scenarios"), table(s, d, "family_bounds"))
    return overlap.overlap_report(*overlap.near_pairs(v))


def p6_near_ids(s: SparkSession, d: str) -> DataFrame:
    """Blueprint ids of valid, dev or final within two edits of one of train: representatives, distance, rows of each."""
    x = table(s, d, "scenarios").select("scenario_row", id_key(F.col("blueprint_id")).alias("blueprint_id"), id_key(F.col("split")).alias("split"))
    x = x.where("split IN ('train', 'valid', 'dev', 'final')")
    return _linked(*segments.near_strings(x, "scenario_row", "blueprint_id", F.col("split") == "train", 2))


def p6_near_prompts(s: SparkSession, d: str) -> DataFrame:
    """First user prompts of other splits within three edits of one of train, in the common form of look-alikes."""
    x = table(s, d, "chat_records").select("record_id", F.expr("try_element_at(filter(messages, m -> m.role = 'user'), 1).content").alias("text"), id_key(F.col("metadata.split")).alias("split"))
    x = lookalike.common_form(spread(x.where("text IS NOT NULL AND split IS NOT NULL")), "text", "form")
    return _linked(*segments.near_strings(x, "record_id", "form", F.col("split") == "train", 3))


def _linked(pairs_: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("class", "is_train").agg(F.count(F.lit(1)).alias("n"))
    a = n.where("is_train").select(F.col("class").alias("class_a"), F.col("n").alias("n_a"))
    b = n.where("NOT is_train").select(F.col("class").alias("class_b"), F.col("n").alias("n_b"))
    return pairs_.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "distance", "n_a", "n_b")


def p7_found(s: SparkSession, d: str) -> DataFrame:
    items = sample.cell_items(table(s, d, "routing_canary"), "task_id", _CATS)
    return sample.short_cells(items, table(s, d, "sample_targets"), _CATS)


def p7_sample(s: SparkSession, d: str) -> DataFrame:
    return sample.stratified_sample(table(s, d, "routing_canary"), table(s, d, "sample_targets"), "task_id", _CATS, "canary_row")


def p7_report(s: SparkSession, d: str) -> DataFrame:
    rows, targets = table(s, d, "routing_canary"), table(s, d, "sample_targets")
    return sample.sample_report(rows, targets, cut(p7_sample(s, d)), "task_id", _CATS, "canary_row")


def _repaired(s: SparkSession, d: str) -> DataFrame:
    docs = spread(table(s, d, "documents").select("doc_id", "text", "lang"))
    return mojibake.repaired(docs, mojibake.train_dictionaries(docs, "text", "lang"), "doc_id", "text", "lang")


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return _repaired(s, d).select("doc_id")


def p10_restored(s: SparkSession, d: str) -> DataFrame:
    return _repaired(s, d)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_token_budget, p1_documents, p1_messages, p2_found, p2_assigned, p2_shares, p3_found, p3_groups, p3_common_forms, p5_found, p5_counts, p6_found, p6_report, p6_near_ids, p6_near_prompts, p7_found, p7_sample, p7_report, p8_containers, p8_report, p9_copies, p9_shares, p10_found, p10_restored)}


def oracle_sql() -> dict[str, str]:
    return {"p6_near_ids": _P6_IDS, "p2_found": _P2, "p6_found": _P6, "p6_report": _P6_REPORT, "p7_found": _P7}


_P2 = r"""
WITH RECURSIVE r AS (
  SELECT scenario_row AS n, nullif(lower(trim(blueprint_id)), '') AS b, lower(trim(split)) AS s,
    CASE WHEN lower(trim(author_id)) NOT IN ('', 'unknown', 'n/a', 'none', 'anonymous') THEN author_id END AS a,
    nullif(lower(trim(search.parent_blueprint_id)), '') AS p
  FROM scenarios
), link AS (
  SELECT coalesce('b:' || b, 'r:' || n) AS x, 'a:' || a AS y FROM r WHERE a IS NOT NULL
  UNION SELECT coalesce('b:' || b, 'r:' || n), 'b:' || p FROM r WHERE p IN (SELECT b FROM r)
), both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
node AS (SELECT DISTINCT coalesce('b:' || b, 'r:' || n) AS x FROM r UNION SELECT x FROM both_ways),
reach AS (
  SELECT x AS top, x FROM node
  UNION
  SELECT reach.top, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.x
), part AS (SELECT x, min(top) AS c FROM reach GROUP BY x),
g AS (SELECT n, s, c FROM r JOIN part ON part.x = coalesce('b:' || b, 'r:' || n)),
bad AS (SELECT c, min(n) AS group_row FROM g GROUP BY c HAVING count(DISTINCT s) > 1)
SELECT n AS scenario_row, group_row FROM g JOIN bad USING (c)
"""

_P6 = r"""
WITH b AS (SELECT lower(replace(trim(family_id), '-', '_')) AS f, parameter_name AS p, upper_bound - lower_bound AS w FROM family_bounds),
k AS (SELECT f, count(*) AS need FROM b GROUP BY f),
v AS (
  SELECT scenario_row AS n, lower(trim(split)) AS s, b.f, b.p, b.w, parameters[b.p] AS x
  FROM scenarios JOIN b ON b.f = lower(replace(trim(family_id), '-', '_'))
  WHERE lower(trim(split)) IN ('train', 'valid', 'dev', 'final') AND parameters[b.p] IS NOT NULL AND isfinite(parameters[b.p])
)
SELECT least(a.n, c.n) AS row_a, greatest(a.n, c.n) AS row_b
FROM v a JOIN v c ON a.f = c.f AND a.p = c.p AND a.s = 'train' AND c.s <> 'train' AND abs(a.x - c.x) / a.w <= 0.005
JOIN k ON k.f = a.f
GROUP BY a.n, c.n, need HAVING count(*) = need
"""

_P6_REPORT = r"""
WITH b AS (SELECT lower(replace(trim(family_id), '-', '_')) AS f, parameter_name AS p, upper_bound - lower_bound AS w FROM family_bounds),
k AS (SELECT f, count(*) AS need FROM b GROUP BY f),
v AS (
  SELECT scenario_row AS n, lower(trim(split)) AS s, source, b.f, b.p, b.w, parameters[b.p] AS x
  FROM scenarios JOIN b ON b.f = lower(replace(trim(family_id), '-', '_'))
  WHERE lower(trim(split)) IN ('train', 'valid', 'dev', 'final') AND parameters[b.p] IS NOT NULL AND isfinite(parameters[b.p])
),
r AS (SELECT n, s, source FROM v JOIN k USING (f) GROUP BY n, s, source, need HAVING count(*) = need),
q AS (
  SELECT a.n AS ra, c.n AS rb, bool_and(a.x = c.x) AS same
  FROM v a JOIN v c ON a.f = c.f AND a.p = c.p AND a.s = 'train' AND c.s <> 'train' AND abs(a.x - c.x) / a.w <= 0.005
  JOIN k ON k.f = a.f GROUP BY a.n, c.n, need HAVING count(*) = need
),
h AS (SELECT ra AS n, bool_or(same) AS same FROM q GROUP BY 1 UNION ALL SELECT rb, bool_or(same) FROM q GROUP BY 1)
SELECT s AS split, source, count(*) AS n_rows, count(*) FILTER (same) AS n_exact, count(*) FILTER (NOT same) AS n_near
FROM r LEFT JOIN h USING (n) GROUP BY s, source
"""

_P6_IDS = r"""
WITH c AS (SELECT lower(trim(blueprint_id)) AS t, lower(trim(split)) = 'train' AS s, min(scenario_row) AS class, count(*) AS n FROM scenarios
  WHERE lower(trim(split)) IN ('train', 'valid', 'dev', 'final') AND trim(blueprint_id) <> '' GROUP BY ALL)
SELECT a.class AS class_a, b.class AS class_b, levenshtein(a.t, b.t)::INT AS distance, a.n AS n_a, b.n AS n_b
FROM c a JOIN c b ON a.s AND NOT b.s AND abs(length(a.t) - length(b.t)) <= 2 AND levenshtein(a.t, b.t) <= 2
"""

_P7 = r"""
WITH n AS (
  SELECT lower(replace(trim(language), '-', '_')) AS l, lower(replace(trim(family_id), '-', '_')) AS f, count(DISTINCT task_id) AS have
  FROM routing_canary GROUP BY ALL
)
SELECT t.language, t.family_id FROM sample_targets t
LEFT JOIN n ON n.l = lower(replace(trim(t.language), '-', '_')) AND n.f = lower(replace(trim(t.family_id), '-', '_'))
WHERE coalesce(have, 0) < greatest(min_rows::DOUBLE, target_share * sample_size)
"""
