"""Connected components by alternating large-star and small-star rounds.

Every round is aggregations and joins over the edge table; nothing about nodes or links reaches the
driver but one fingerprint of the edge set and the short list of hubs. Rounds are cut with a reliable
checkpoint. Links of a node with a large share of all links are spread over slots in each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.skew import LEAST, PARTS, hot_keys, salted_on
from lodestat.session import cut


def _star(edges: DataFrame, least: DataFrame, least_rows: int | None) -> DataFrame:
    """Links (u, v) moved to (v, m) with m the least neighbour of u. `least` has (u, m, n), n links of u; without
    least_rows no node can have enough links to be spread."""
    hot = None if least_rows is None else hot_keys(least, ["u"], "n", PARTS, least_rows)
    return salted_on(edges, least.drop("n"), ["u"], F.col("v"), hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame, least_rows: int | None) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _star(both.where("v > u"), least, least_rows).where("u != v").distinct()


def _small_star(edges: DataFrame, least_rows: int | None) -> DataFrame:
    # a link (u, v) has u > v here: the neighbours of u are all smaller
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _star(edges, least, least_rows).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, least_rows: int = LEAST) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node of the component.

    Null ends and self-links tie nothing and are left out; repeated links count once. Nodes that
    occur in no link are not listed (the caller coalesces). Raises if the rounds don't settle. Nodes with more
    than `least_rows` links and more than their share of all are spread in the joins."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.where("x is not null and y is not null and u != v").select("u", "v").distinct())
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        rows = least_rows if 2 * mark[0] > least_rows else None
        large = _large_star(e, rows)
        e = cut(_small_star(large if rows is None else cut(large), rows))
        last, mark = mark, _mark(e)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
