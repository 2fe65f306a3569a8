"""Tables written to and read back from files of each kind, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.keys import code_key
from lodestat.session import shared_folder
from lodestat.sources import files
from lodestat.sources.tables import table


def _place(s: SparkSession) -> str:
    return shared_folder(s) + f"/files-{uuid.uuid4().hex}"


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    p = _place(s) + ".csv"
    x = table(s, d, "orders")
    files.write_csv(x, p)
    return files.read_table(s, p, x.schema)


def tsv_round_trip(s: SparkSession, d: str) -> DataFrame:
    p = _place(s) + ".tsv"
    x = table(s, d, "part")
    x.write.csv(p, header=True, sep="\t", escape='"')
    return files.read_table(s, p, x.schema)


def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Nested chat records as JSON lines."""
    p = _place(s) + ".jsonl"
    x = table(s, d, "chat_records").select("record_id", "messages", "metadata")
    files.write_records(x, p)
    back = files.read_records(s, p, x.schema)
    return back.select("record_id", F.size("messages").alias("n_messages"), F.col("metadata.source_repo").alias("source_repo"), F.col("metadata.token_count").alias("token_count"), F.md5(F.element_at("messages", 1)["content"]).alias("first_digest"))


def pending_work(s: SparkSession, d: str) -> DataFrame:
    """Scenario rows whose blueprint no prediction has yet."""
    return files.pending(table(s, d, "scenarios").select("scenario_row", "blueprint_id"), table(s, d, "predictions").select("blueprint_id"), ["blueprint_id"])


def file_digests(s: SparkSession, d: str) -> DataFrame:
    """Length and digest of a text file per language with all canary texts of it."""
    p = _place(s)
    t = table(s, d, "routing_canary").where("text IS NOT NULL").select(code_key(F.col("language")).alias("language"), F.col("canary_row"), F.regexp_replace("text", "[\r\n]+", " ").alias("value"))
    t.where("language IS NOT NULL").repartition("language").sortWithinPartitions("language", "canary_row").select("language", "value").write.partitionBy("language").text(p)
    out = files.file_digests(s, p).where("path LIKE '%.txt'")
    return out.select(F.regexp_extract("path", "language=([^/]+)/", 1).alias("language"), "length", "sha256")


def json_document(s: SparkSession, d: str) -> DataFrame:
    """The fixed table of bounds as one JSON document over several lines, read back whole."""
    p = _place(s) + ".json"
    rows = [r.asDict() for r in table(s, d, "family_bounds").collect()]  # a fixed table
    files.write_manifest(s, p, rows)
    return files.read_table(s, p).select("family_id", "domain", "parameter_name", "lower_bound", "upper_bound", "is_integer")


def fingerprint_work(s: SparkSession, d: str) -> DataFrame:
    """Scenario rows without predictions under their present fingerprint (blueprint and family as spelled): a
    result kept under another spelling of the family counts as out of date."""
    mark = F.sha2(F.concat_ws("|", F.coalesce("blueprint_id", F.lit("")), F.coalesce("family_id", F.lit(""))), 256).alias("fingerprint")
    work = table(s, d, "scenarios").select("scenario_row", "blueprint_id", mark)
    done = table(s, d, "predictions").select("blueprint_id", mark)
    return files.pending(work, done, ["blueprint_id", "fingerprint"]).select("scenario_row", "fingerprint")


def queries() -> dict:
    return {f.__name__: f for f in (csv_round_trip, tsv_round_trip, jsonl_round_trip, json_document, pending_work, fingerprint_work, file_digests)}


def oracle_sql() -> dict[str, str]:
    return {
        "csv_round_trip": "SELECT * FROM orders",
        "tsv_round_trip": "SELECT * FROM part",
        "jsonl_round_trip": "SELECT record_id, len(messages)::INT AS n_messages, metadata.source_repo AS source_repo, metadata.token_count AS token_count, md5(messages[1].content) AS first_digest FROM chat_records",
        "pending_work": "SELECT scenario_row, blueprint_id FROM scenarios s WHERE NOT EXISTS (FROM predictions p WHERE p.blueprint_id = s.blueprint_id)",
        "file_digests": r"SELECT language, octet_length(encode(t))::BIGINT AS length, sha256(t) AS sha256 FROM (SELECT lower(replace(trim(language), '-', '_')) AS language, string_agg(regexp_replace(text, '[\r\n]+', ' ', 'g') || chr(10), '' ORDER BY canary_row) AS t FROM routing_canary WHERE text IS NOT NULL AND language IS NOT NULL GROUP BY 1)",
        "json_document": "SELECT family_id, domain, parameter_name, lower_bound, upper_bound, is_integer FROM family_bounds",
        "fingerprint_work": "SELECT scenario_row, sha256(coalesce(blueprint_id, '') || '|' || coalesce(family_id, '')) AS fingerprint FROM scenarios s WHERE NOT EXISTS (FROM predictions p WHERE p.blueprint_id = s.blueprint_id AND coalesce(p.family_id, '') = coalesce(s.family_id, ''))",
    }
