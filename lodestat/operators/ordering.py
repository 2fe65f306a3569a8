"""Running totals and ranks inside groups of any size, without one task per group.

A plain window over a group sorts the whole group in one task. Here each group is cut into slices
by the leading bits of a sort key; slice totals (few) are accumulated first, then only the rows of
a slice meet in one task. A group with a third of all rows therefore spreads over all slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "__rt_slice"
#: Slices of a group: at 10 ** 11 rows in one group a slice has some 6 million.
SLICES = 16_384


def hash_order(seed: int, *cols: Column | str) -> Column:
    """A stable random order key: non-negative 63-bit hash of the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def value_slices(df: DataFrame, value: str, slices: int = 512, into: str = "__slice_of") -> tuple[DataFrame, Column]:
    """(df with a slice number that rises with a number column, that column). Bounds are approximate quantiles, so
    slices hold about equally many rows however skewed the values are; equal values are in one slice.
    Bounds are at most `slices` numbers; looking one up is a binary search. Infinities go to the ends."""
    d = df.withColumn("__value_of", F.col(value).cast("double"))
    ask = [i / slices for i in range(1, slices)]
    finite = F.abs("__value_of") < float("inf")
    got = d.where(finite).agg(F.percentile_approx("__value_of", ask, 50 * slices).alias("q")).first()["q"] or []
    bounds = sorted(set(got))
    if not bounds:
        return d.drop("__value_of").withColumn(into, F.lit(0)), F.col(into)
    d = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__value_of", outputCol="__bucket", handleInvalid="keep").transform(d)
    return d.withColumn(into, F.col("__bucket").cast("int")).drop("__bucket", "__value_of"), F.col(into)


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    tie: Sequence[str] = (),
    slices: int = SLICES,
    slice_of: Column | None = None,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds a column per entry of `values`: its sum over the earlier rows of the group plus the row's own.
    `whole` names columns for the sums over the whole group, by entry of `values`.

    `order` is a non-negative 63-bit hash (see hash_order) unless slice_of gives, for each row, a
    slice number that rises with `order`. Rows with equal order are told apart by `tie`.
    Null group values form a group of their own; an empty table stays empty.
    """
    keys = [F.col(g) for g in groups]
    names = list(values)
    val, tot, inn, base = ([f"__rt_{k}{i}" for i in range(len(names))] for k in ("value", "total", "inner", "base"))
    cut = slice_of if slice_of is not None else F.floor(F.col(order) / F.lit((1 << 63) / slices)).cast("int")
    d = df.withColumns({_SLICE: cut} | {v: values[n] for v, n in zip(val, names)})
    totals = d.groupBy(*groups, _SLICE).agg(*[F.sum(v).alias(t) for v, t in zip(val, tot)])
    w = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = dict(whole or {})
    of_all = Window.partitionBy(*keys)
    sums = [F.sum(tot[names.index(n)]).over(of_all).alias(into) for n, into in whole.items()]
    bases = totals.select(*[F.col(g).alias(f"__rt_g{i}") for i, g in enumerate(groups)], F.col(_SLICE).alias("__rt_s"), *[F.coalesce(F.sum(t).over(w), F.lit(0)).alias(b) for t, b in zip(tot, base)], *sums)
    cond = F.col(_SLICE) == F.col("__rt_s")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__rt_g{i}"))
    inner = Window.partitionBy(*keys, F.col(_SLICE)).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = d.withColumns({i: F.sum(v).over(inner) for i, v in zip(inn, val)}).join(bases, cond)
    made = {n: F.col(b) + F.col(i) for n, b, i in zip(names, base, inn)}
    return joined.withColumns(made).drop(_SLICE, "__slice_of", "__rt_s", *val, *inn, *base, *[f"__rt_g{i}" for i in range(len(groups))])


def running_total(df: DataFrame, groups: Sequence[str], order: str, value: Column, into: str, tie: Sequence[str] = (), slices: int = SLICES, slice_of: Column | None = None) -> DataFrame:
    """running_totals for a single column."""
    return running_totals(df, groups, order, {into: value}, tie, slices, slice_of)


def group_rank(df: DataFrame, groups: Sequence[str], order: str, into: str = "rank", tie: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """Adds the 1-based rank of each row in its group by a hash order."""
    return running_total(df, groups, order, F.lit(1).cast("long"), into, tie, slices)
