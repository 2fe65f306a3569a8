"""Column profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, most_levels: int = 20, examples: int = 3) -> DataFrame:
    """One row per column: name, dtype, missing, unique, examples, levels (only up to most_levels of
    them), minimum, maximum, zero_fraction of the values that read as numbers. All columns are profiled
    in one long aggregation; distinct values are counted by group, never gathered."""
    n = len(df.columns)
    if not n:
        raise ValueError("a profile needs columns")
    complex_ = (T.ArrayType, T.MapType, T.StructType)
    as_text = [F.to_json(c) if isinstance(df.schema[c].dataType, complex_) else F.col(c).cast("string") for c in df.columns]
    stacked = df.select(F.posexplode(F.array(*as_text)).alias("pos", "value"))
    value = F.when(F.col("value") != "NaN", F.col("value"))
    per = stacked.select("pos", value.alias("value")).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    num = F.expr("try_cast(value AS DOUBLE)")
    some = per.withColumn("num", num)
    out = some.groupBy("pos").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique"),
        F.min("num").alias("minimum"),
        F.max("num").alias("maximum"),
        (F.sum(F.when(F.col("num") == 0, F.col("n")).when(F.col("num").isNotNull(), 0)) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("zero_fraction"),
    )
    # the smallest most_levels of a column; both branches read the same columns of `per`, so its shuffle is used twice
    w = Window.partitionBy("pos").orderBy(F.col("value").asc_nulls_last())
    first = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_levels).groupBy("pos").agg(F.array_sort(F.collect_list("value")).alias("head"), F.max("n").alias("__most")).drop("__most")
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "pos int, name string, dtype string")
    d = names.join(out, "pos", "left").join(first, "pos", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("name", "dtype", zero("missing"), zero("unique"), F.slice("head", 1, examples).alias("examples"), F.when(F.col("unique") <= most_levels, F.col("head")).alias("levels"), "minimum", "maximum", "zero_fraction")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: all rows, distinct rows, rows equal to an earlier one."""
    d = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return d.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
