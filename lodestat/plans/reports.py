"""Run reports: JSON payloads into manifests, cycles, candidates and surfaces that keep their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.keys import id_key
from lodestat.operators.nested import nested_rows

_CAND, _SURF = "cycles[].validation.candidate", "selection.selection_surfaces"
_MANIFEST = ["split", "fingerprint", "seed", "count", "view", "immutable", "schema_version"]
_CYCLE = ["cycle", "planned_microsteps", "promoted"]
_METRICS = ["normalized_regret", "accuracy", "invalid_selection_rate", "checkpoint"]


def _number(value: str) -> Column:
    """A finite number written as text, else null: NaN, infinities, blanks and words are none."""
    return F.expr(
        f"CASE WHEN trim({value}) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' "
        f"AND abs(try_cast(trim({value}) AS DOUBLE)) < double('Infinity') THEN try_cast(trim({value}) AS DOUBLE) END"
    )


def report_nodes(reports: DataFrame) -> DataFrame:
    """All wanted nodes of all payloads, one row each."""
    paths = ["manifest", "cycles[]", _CAND, f"{_CAND}[]", _SURF, f"{_SURF}[]"]
    paths += [f"manifest.{m}" for m in _MANIFEST] + [f"cycles[].{m}" for m in _CYCLE]
    paths += [f"{p}.{m}" for p in (_CAND, f"{_CAND}[]") for m in _METRICS] + [f"{_SURF}.{m}" for m in ("name", "count")] + [f"{_SURF}[].{m}" for m in ("name", "count")]
    return nested_rows(reports, "payload", ["report_id", "report_kind"], paths, wrapper="report")


def _rows(nodes: DataFrame, own: list[str], members: list[str]) -> DataFrame:
    """One row per node on one of the paths `own`, its scalar members as columns.

    Members and node meet in one aggregation by (report, node), which needs one shuffle."""
    is_own = F.col("path").isin(own)
    wanted = nodes.where(is_own | F.col("path").isin([f"{p}.{m}" for p in own for m in members]))
    at = F.when(is_own, F.col("node")).otherwise(F.col("parent_node"))
    value = {m: F.max(F.when(F.col("path").isin([f"{p}.{m}" for p in own]) & (F.col("kind") != "null"), F.col("value"))).alias(m) for m in members}
    kinds = {m: F.max(F.when(F.col("path").isin([f"{p}.{m}" for p in own]), F.col("kind"))).alias(f"{m}_kind") for m in members}
    one = lambda c: F.max(F.when(is_own, F.col(c)))
    return wanted.groupBy("report_id", "report_kind", at.alias("node")).agg(one("path").alias("path"), one("parent_node").alias("parent_node"), one("pos").alias("pos"), one("kind").alias("kind"), one("value").alias("own_value"), *value.values(), *kinds.values())


def manifests(nodes: DataFrame) -> DataFrame:
    """Every manifest object of a report, also with a null split."""
    d = _rows(nodes, ["manifest"], _MANIFEST).where("kind = 'object'")
    return d.select("report_id", "report_kind", F.col("node").alias("manifest_node"), "split", "split_kind", "fingerprint", *[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("seed", "count", "schema_version")], "view", F.expr("try_cast(immutable AS BOOLEAN)").alias("immutable"))


def cycles(nodes: DataFrame) -> DataFrame:
    d = _rows(nodes, ["cycles[]"], _CYCLE).where("kind = 'object'")
    return d.select("report_id", F.col("node").alias("cycle_node"), F.col("pos").alias("cycle_pos"), F.expr("try_cast(cycle AS BIGINT)").alias("cycle"), F.expr("try_cast(planned_microsteps AS BIGINT)").alias("planned_microsteps"), F.expr("try_cast(promoted AS BOOLEAN)").alias("promoted"))


def candidates(nodes: DataFrame) -> DataFrame:
    """Every candidate object with its cycle; regret is null where it is no finite number."""
    d = _rows(nodes, [_CAND, f"{_CAND}[]"], _METRICS).where("kind = 'object'")
    # an entry of a candidate array hangs on the array node, that on the cycle
    arrays = nodes.where((F.col("path") == _CAND) & (F.col("kind") == "array")).select("report_id", F.col("node").alias("array_node"), F.col("parent_node").alias("array_parent"))
    c = cycles(nodes).select("report_id", "cycle_node", "cycle_pos", "cycle")
    up = arrays.select("report_id", F.col("array_node").alias("parent_node"), "array_parent")
    d = d.join(up, ["report_id", "parent_node"], "left").withColumn("cycle_node", F.coalesce("array_parent", "parent_node"))
    numeric = F.col("normalized_regret_kind").isin("number", "string")
    return d.join(c, ["report_id", "cycle_node"]).select("report_id", "cycle_node", "cycle_pos", "cycle", F.col("node").alias("candidate_node"), "pos", F.when(numeric, _number("normalized_regret")).alias("normalized_regret"), *[_number(m).alias(m) for m in ("accuracy", "invalid_selection_rate")], "checkpoint")


def surfaces(nodes: DataFrame) -> DataFrame:
    """Every non-null selection surface, whether in an array or alone, as text or as an object with a name."""
    d = _rows(nodes, [_SURF, f"{_SURF}[]"], ["name", "count"]).where("kind NOT IN ('null', 'array') OR (kind = 'array' AND path LIKE '%[]')")
    return d.select("report_id", F.col("node").alias("surface_node"), "pos", F.coalesce("own_value", "name").alias("surface"), F.expr("try_cast(count AS BIGINT)").alias("rows"))


def found(nodes: DataFrame) -> DataFrame:
    """(report_id, child, parent_no, pos) as the test tables define it."""
    long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else F.lit(c).cast("bigint")
    m = manifests(nodes).where((id_key(F.col("report_kind")) == "family-router-replication") & F.col("split_kind").isNotNull() & (F.col("split_kind") != "null"))
    m = m.select("report_id", F.lit("manifest").alias("child"), long(0).alias("parent_no"), long(0).alias("pos"))
    c = candidates(nodes).where("normalized_regret IS NOT NULL").select("report_id", F.lit("candidate").alias("child"), long("cycle").alias("parent_no"), long("pos").alias("pos"))
    s = surfaces(nodes).select("report_id", F.lit("surface").alias("child"), long(0).alias("parent_no"), long("pos").alias("pos"))
    return m.unionByName(c).unionByName(s)
