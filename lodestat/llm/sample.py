"""A sample with given shares per category (problem 7).

Systematic sampling with unequal probabilities: items in random order inside sorted categories, a
running total of inclusion probabilities over all of them, one random start, and every item whose
interval holds a whole number is taken. Categories short of their minimum are then filled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.keys import code_key
from lodestat.operators.ordering import group_rank, hash_order
from lodestat.session import cut


def distinct_items(rows: DataFrame, item: str, cats: list[str], key: str) -> DataFrame:
    """One row per item: that with the smallest key gives its categories. Null items are left out."""
    first = F.min(F.struct(F.col(key), *[code_key(F.col(c)).alias(c) for c in cats])).alias("f")
    return rows.where(F.col(item).isNotNull()).groupBy(item).agg(first).select(item, *[F.col(f"f.{c}").alias(c) for c in cats])


def cell_items(rows: DataFrame, item: str, cats: list[str]) -> DataFrame:
    """Distinct pairs of item and category: an item that occurs in two cells counts in both."""
    return rows.where(F.col(item).isNotNull()).select(item, *[code_key(F.col(c)).alias(c) for c in cats]).distinct()


def cell_needs(items: DataFrame, targets: DataFrame, cats: list[str]) -> DataFrame:
    """Each line of the targets, spelled as there, with `available` items and the number it needs."""
    n = items.groupBy(*[F.col(c).alias(f"__{c}") for c in cats]).agg(F.count(F.lit(1)).alias("n"))
    t = targets
    cond = F.lit(True)
    for c in cats:
        cond = cond & code_key(t[c]).eqNullSafe(F.col(f"__{c}"))
    need = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_size"))
    return t.join(n, cond, "left").select(*[t[c] for c in cats], "target_share", "min_rows", "sample_size", F.coalesce("n", F.lit(0)).alias("available"), need.alias("needed"))


def short_cells(items: DataFrame, targets: DataFrame, cats: list[str]) -> DataFrame:
    """The cells that cannot supply their number."""
    return cell_needs(items, targets, cats).where("available < needed").select(*cats)


def stratified_sample(rows: DataFrame, targets: DataFrame, item: str, cats: list[str], key: str, seed: int = 0) -> DataFrame:
    """(item, categories, inclusion, reason): reason is `crossing` or `floor`.

    An item's probability is the cell's target count over its items, at most 1. Items in cells
    without a target are never drawn; a cell with too few items gives all it has and is reported by
    sample_report. Cells the crossings leave below min_rows are filled in hash order. Equal seeds
    give equal samples for any partitioning; empty tables give an empty sample.
    """
    items = cut(distinct_items(rows, item, cats, key))
    cells = cell_needs(items, targets, cats).where("available > 0")
    goal = F.col("target_share") * F.col("sample_size")
    w = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[code_key(F.col(c)).alias(f"__{c}") for c in cats], "available", "min_rows", F.least(F.lit(1.0), goal / F.col("available")).alias("inclusion"), F.concat_ws("|", *[code_key(F.col(c)) for c in cats]).alias("__cell"))
    # one line per cell: a plain window over them is small
    cells = cells.withColumn("__base", F.coalesce(F.sum(F.col("inclusion") * F.col("available")).over(w), F.lit(0.0)))
    cond = F.lit(True)
    for c in cats:
        cond = cond & items[c].eqNullSafe(F.col(f"__{c}"))
    d = items.join(cells, cond).withColumn("__h", hash_order(seed, F.col(item)))
    d = group_rank(d, ["__cell"], "__h", "__rank", tie=[item])
    start = F.lit(((seed * 2654435761 + 12345) % 1000003 + 0.5) / 1000003.0)
    upto = lambda r: F.floor(F.col("__base") + r * F.col("inclusion") + start + F.lit(1e-9))
    d = d.withColumn("__hit", upto(F.col("__rank")) > upto(F.col("__rank") - 1))
    d = cut(d)
    taken = d.groupBy("__cell").agg(F.count(F.when(F.col("__hit"), 1)).alias("__taken"), F.first("min_rows").alias("__min"))
    lack = taken.where("__taken < __min").select("__cell", (F.col("__min") - F.col("__taken")).alias("__lack"))
    rest = d.where("NOT __hit").join(lack, "__cell")
    filled = group_rank(rest, ["__cell"], "__h", "__again", tie=[item]).where("__again <= __lack")
    pick = lambda x, why: x.select(item, *cats, "inclusion", F.lit(why).alias("reason"))
    return pick(d.where("__hit"), "crossing").unionByName(pick(filled, "floor"))


def sample_report(rows: DataFrame, targets: DataFrame, sample: DataFrame, item: str, cats: list[str], key: str) -> DataFrame:
    """Per target cell: distinct items there (`available`), those of them that the draw counts in this cell, as it takes
    an item once, where its first row lies (`drawable`), wanted and drawn numbers, target and reached share, and
    whether the cell could supply its number."""
    needs = cell_needs(cell_items(rows, item, cats), targets, cats)
    own = distinct_items(rows, item, cats, key).groupBy(*[F.col(c).alias(f"__d{c}") for c in cats]).agg(F.count(F.lit(1)).alias("d"))
    got = sample.groupBy(*[F.col(c).alias(f"__{c}") for c in cats]).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("__total"))
    cond, cond_own = F.lit(True), F.lit(True)
    for c in cats:
        cond = cond & code_key(needs[c]).eqNullSafe(F.col(f"__{c}"))
        cond_own = cond_own & code_key(needs[c]).eqNullSafe(F.col(f"__d{c}"))
    d = needs.join(own, cond_own, "left").join(got, cond, "left").crossJoin(total)
    drawable = F.coalesce("d", F.lit(0))
    return d.select(*[needs[c] for c in cats], "available", drawable.alias("drawable"), "needed", F.coalesce("n", F.lit(0)).alias("drawn"), "target_share", F.round(F.coalesce("n", F.lit(0)) / F.col("__total"), 6).alias("share"), (drawable >= F.col("needed")).alias("can_supply"))
