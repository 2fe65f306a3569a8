"""Joins in which one key may hold a third of all rows.

Keys with more than 1 / parts of all rows are fewer than `parts` by counting, so the list of them may go to
the driver and be broadcast whatever the table's size. Rows of such a key are spread over slots, and the
other side's rows of that key are repeated once per slot: at most 2 * parts repeats per row a key has
there. All other keys join as they are, and without hot keys the join is a plain one. Nothing is capped
and no key is dropped. The numbers of rows per key are counted when the join is built: give tables that
are cut or cheap to read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of all rows, as one in so many, from which a key is spread.
PARTS = 512
#: Fewer rows than these in a key are never spread.
LEAST = 20_000

_SLOTS = "__slots"
_SLOT = "__slot"


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", parts: int = PARTS, least: int = LEAST) -> DataFrame | None:
    """(keys, __slots): keys with more than max(least, total / parts) rows, fewer than `parts` of them; None
    if there is none. `counts` has a line per key with its number of rows. A null key matches nothing, but its
    rows, which an outer join keeps, are spread too."""
    total = counts.agg(F.sum(n).alias("__total"))
    size = F.greatest(F.lit(float(least)), F.col("__total") / F.lit(parts))
    hot = counts.where(F.col(n) > least).crossJoin(F.broadcast(total)).where(F.col(n) > size)
    hot = hot.select(*keys, F.ceil(F.col(n) / size).cast("int").alias(_SLOTS))
    rows = hot.collect()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in hot.schema])
    return counts.sparkSession.createDataFrame(rows, schema) if rows else None


def _with_slots(df: DataFrame, hot: DataFrame | None, on: Sequence[str]) -> DataFrame:
    if hot is None:
        return df.withColumn(_SLOTS, F.lit(1))
    h = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in on], F.col(_SLOTS).alias("__hot_slots"))
    cond = F.lit(True)
    for k in on:
        cond = cond & df[k].eqNullSafe(F.col(f"__hot_{k}"))
    d = df.join(F.broadcast(h), cond, "left").withColumn(_SLOTS, F.coalesce("__hot_slots", F.lit(1)))
    return d.drop("__hot_slots", *[f"__hot_{k}" for k in on])


def spread_rows(df: DataFrame, hot: DataFrame | None, on: Sequence[str], by: Column, into: str = _SLOT) -> DataFrame:
    """Adds a slot: 0, or for a row of a hot key one by the hash of `by`."""
    return _with_slots(df, hot, on).withColumn(into, F.pmod(F.xxhash64(by), F.col(_SLOTS)).cast("int")).drop(_SLOTS)


def repeat_rows(df: DataFrame, hot: DataFrame | None, on: Sequence[str], into: str = _SLOT) -> DataFrame:
    """A row per slot of its key."""
    if hot is None:
        return df.withColumn(into, F.lit(0))
    return _with_slots(df, hot, on).withColumn(into, F.explode(F.sequence(F.lit(0), F.col(_SLOTS) - 1))).drop(_SLOTS)


def _counted(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], by: Column, how: str = "inner", counts: DataFrame | None = None, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """many JOIN few on equal columns `on` (how: inner, left, left_semi, left_anti), with the rows of hot keys
    of `many` spread by the hash of `by`. `counts` (on, n) may bring the numbers of rows per key of `many`,
    if the caller has them already."""
    hot = hot_keys(_counted(many, on) if counts is None else counts, on, "n", parts, least)
    return salted_on(many, few, on, by, hot, how)


def salted_on(many: DataFrame, few: DataFrame, on: Sequence[str], by: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """salted_join with a list of hot keys made before."""
    on = list(on)
    if hot is None:
        return many.join(few, on, how)
    return spread_rows(many, hot, on, by).join(repeat_rows(few, hot, on), [*on, _SLOT], how).drop(_SLOT)


def both_salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], by_left: Column, by_right: Column, left_hot: DataFrame | None, right_hot: DataFrame | None) -> DataFrame:
    """An inner join in which either side may have hot keys: the rows of a key form a grid of slots, and a row
    is repeated along the other side's slots. Where both are many, the result is larger than the repeats."""
    on, other = list(on), "__slot_r"
    if left_hot is None and right_hot is None:
        return left.join(right, on)
    x = repeat_rows(spread_rows(left, left_hot, on, by_left), right_hot, on, other)
    y = repeat_rows(spread_rows(right, right_hot, on, by_right, other), left_hot, on)
    return x.join(y, [*on, _SLOT, other]).drop(_SLOT, other)
