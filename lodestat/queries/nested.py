"""Queries over the nested run reports (problem 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.plans import reports as R
from lodestat.session import cut, spread
from lodestat.sources.tables import table


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return R.report_nodes(spread(table(spark, folder, "run_reports").select("report_id", "report_kind", "payload")))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return cut(_scan(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The flat tables are keyed by report and places in arrays, which link child to parent: a candidate to the
    cycle at cycle_pos of its report."""
    return {
        "p4_found": lambda s, d: R.found(_nodes(s, d)),
        "p4_manifests": lambda s, d: R.manifests(_scan(s, d)).drop("manifest_node"),
        "p4_cycles": lambda s, d: R.cycles(_scan(s, d)).drop("cycle_node"),
        "p4_candidates": lambda s, d: R.candidates(_nodes(s, d)).drop("cycle_node", "candidate_node"),
        "p4_surfaces": lambda s, d: R.surfaces(_scan(s, d)).drop("surface_node"),
    }


def oracle_sql() -> dict[str, str]:
    flat = _FOUND[: _FOUND.index("SELECT report_id, 'manifest' AS child")]
    text = lambda j, m: f"CASE WHEN json_type({j} -> '$.{m}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {j} ->> '$.{m}' END"
    cast = lambda j, m, kind: f"try_cast({text(j, m)} AS {kind}) AS {m}"
    finite = lambda j, m: f"CASE WHEN regexp_full_match(trim({text(j, m)}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim({text(j, m)}) AS DOUBLE) END"
    kind = "CASE json_type(m -> '$.split') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN json_type(m -> '$.split') IS NOT NULL THEN 'number' END END"
    return {
        "p4_found": _FOUND,
        "p4_manifests": f"{flat} SELECT report_id, report_kind, {text('m', 'split')} AS split, {kind} AS split_kind, {text('m', 'fingerprint')} AS fingerprint, {cast('m', 'seed', 'BIGINT')}, {cast('m', 'count', 'BIGINT')}, {cast('m', 'schema_version', 'BIGINT')}, {text('m', 'view')} AS view, {cast('m', 'immutable', 'BOOLEAN')} FROM (SELECT report_id, report_kind, j -> '$.manifest' AS m FROM root) WHERE json_type(m) = 'OBJECT'",
        "p4_cycles": f"{flat} SELECT report_id, cycle_pos, {cast('c', 'cycle', 'BIGINT')}, {cast('c', 'planned_microsteps', 'BIGINT')}, {cast('c', 'promoted', 'BOOLEAN')} FROM place WHERE json_type(c) = 'OBJECT'".replace(" SELECT report_id, cycle_pos", _PLACE + " SELECT report_id, cycle_pos", 1),
        "p4_candidates": flat
        + _PLACE
        + f""", held AS (SELECT report_id, cycle_pos, {cast('c', 'cycle', 'BIGINT')}, c -> '$.validation.candidate' AS k FROM place WHERE json_type(c) = 'OBJECT'),
each AS (SELECT report_id, cycle_pos, cycle, k AS e, 0 AS pos FROM held WHERE json_type(k) = 'OBJECT' UNION ALL
  SELECT report_id, cycle_pos, cycle, unnest(k::JSON[]) AS e, unnest(range(json_array_length(k)::BIGINT)) AS pos FROM held WHERE json_type(k) = 'ARRAY')
SELECT report_id, cycle_pos, cycle, pos, CASE WHEN json_type(e -> '$.normalized_regret') <> 'BOOLEAN' THEN {finite('e', 'normalized_regret')} END AS normalized_regret, {finite('e', 'accuracy')} AS accuracy, {finite('e', 'invalid_selection_rate')} AS invalid_selection_rate, {text('e', 'checkpoint')} AS checkpoint FROM each WHERE json_type(e) = 'OBJECT'""",
        "p4_surfaces": f"{flat} SELECT report_id, pos, CASE WHEN json_type(e) = 'OBJECT' THEN {text('e', 'name')} WHEN json_type(e) <> 'ARRAY' THEN e ->> '$' END AS surface, CASE WHEN json_type(e) = 'OBJECT' THEN try_cast({text('e', 'count')} AS BIGINT) END AS rows FROM surface WHERE e IS NOT NULL AND json_type(e) <> 'NULL'",
    }


_PLACE = """, place AS (SELECT report_id, unnest(CASE WHEN json_type(j -> '$.cycles') = 'ARRAY' THEN (j -> '$.cycles')::JSON[] END) AS c, unnest(CASE WHEN json_type(j -> '$.cycles') = 'ARRAY' THEN range(json_array_length(j -> '$.cycles')::BIGINT) END) AS cycle_pos FROM root)"""

_FOUND = r"""
WITH RECURSIVE step AS (
  SELECT report_id, report_kind, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM run_reports WHERE payload IS NOT NULL
  UNION ALL
  SELECT report_id, report_kind,
    CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j -> '$.report' END
  FROM step WHERE json_type(j) = 'VARCHAR' OR (json_type(j) = 'OBJECT' AND json_type(j -> '$.report') IN ('OBJECT', 'VARCHAR'))
), root AS (
  SELECT report_id, report_kind, j FROM step
  WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j -> '$.report') NOT IN ('OBJECT', 'VARCHAR'), true)
), cycle AS (
  SELECT report_id, unnest(CASE WHEN json_type(j -> '$.cycles') = 'ARRAY' THEN (j -> '$.cycles')::JSON[] END) AS c FROM root
), cand AS (
  SELECT report_id, (c ->> '$.cycle')::BIGINT AS cycle, c -> '$.validation.candidate' AS k FROM cycle
), entry AS (
  SELECT report_id, cycle, k AS e, 0 AS pos FROM cand WHERE json_type(k) = 'OBJECT'
  UNION ALL
  SELECT report_id, cycle, unnest(k::JSON[]) AS e, unnest(range(json_array_length(k)::BIGINT)) AS pos FROM cand WHERE json_type(k) = 'ARRAY'
), surf AS (
  SELECT report_id, j -> '$.selection.selection_surfaces' AS s FROM root
), surface AS (
  SELECT report_id, s AS e, 0 AS pos FROM surf WHERE json_type(s) NOT IN ('ARRAY', 'NULL')
  UNION ALL
  SELECT report_id, unnest(s::JSON[]) AS e, unnest(range(json_array_length(s)::BIGINT)) AS pos FROM surf WHERE json_type(s) = 'ARRAY'
)
SELECT report_id, 'manifest' AS child, 0::BIGINT AS parent_no, 0::BIGINT AS pos FROM root
WHERE lower(trim(report_kind)) = 'family-router-replication' AND json_type(j -> '$.manifest') = 'OBJECT' AND json_type(j -> '$.manifest.split') <> 'NULL'
UNION ALL
SELECT report_id, 'candidate', cycle, pos::BIGINT FROM entry
WHERE json_type(e) = 'OBJECT' AND json_type(e -> '$.normalized_regret') <> 'BOOLEAN'
  AND regexp_full_match(trim(e ->> '$.normalized_regret'), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
UNION ALL
SELECT report_id, 'surface', 0::BIGINT, pos::BIGINT FROM surface WHERE e IS NOT NULL AND json_type(e) <> 'NULL'
"""
