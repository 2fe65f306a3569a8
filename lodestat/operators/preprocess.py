"""Declared row filters, recodes and complete cases; group levels; design columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AnalysisError(ValueError):
    """A request that the data or the procedure cannot serve."""


def require_columns(df: DataFrame, names: Sequence[str | None]) -> None:
    missing = [n for n in names if not n]
    if missing:
        raise AnalysisError("missing variable roles")
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise AnalysisError(f"columns do not exist: {', '.join(unknown)}")


def row_filters(df: DataFrame, filters: Sequence[Mapping]) -> DataFrame:
    """Applied in order. include keeps listed values (null never matches); exclude drops listed values
    and keeps nulls, which SQL's NOT IN would drop."""
    for f in filters:
        column, values, op = f.get("column"), f.get("values"), f.get("operation", "include")
        require_columns(df, [column])
        if not isinstance(values, (list, tuple)) or not values:
            raise AnalysisError("a row filter needs a list of values")
        hit = F.col(column).isin(list(values))
        if op == "include":
            df = df.where(hit)
        elif op == "exclude":
            df = df.where(~F.coalesce(hit, F.lit(False)))
        else:
            raise AnalysisError(f"unsupported row filter: {op}")
    return df


def recode_binary(df: DataFrame, recodes: Sequence[Mapping]) -> DataFrame:
    """Listed values become 1, others 0, missing stays missing."""
    for r in recodes:
        column, values = r.get("column"), r.get("positive_values")
        require_columns(df, [column])
        if not values:
            raise AnalysisError("a recode needs positive values")
        df = df.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column).isin(list(values)).cast("int")))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns used, rows without null or NaN in them."""
    require_columns(df, columns)
    return df.select(*dict.fromkeys(columns)).dropna()


def number(c: str) -> Column:
    return F.col(c).cast("double")


def text_like(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType))


def levels(df: DataFrame, column: str, most: int | None = None) -> list:
    """Distinct values in ascending order. `most` bounds what comes to the driver: one more is an error."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    got = [r[0] for r in (d.limit(most + 1) if most else d).collect()]
    if most and len(got) > most:
        raise AnalysisError(f"{column} has more than {most} levels")
    return got


def two_levels(df: DataFrame, column: str) -> list:
    got = levels(df, column, 2)
    if len(got) != 2:
        raise AnalysisError(f"{column} must have exactly two levels")
    return got


#: Most levels of a categorical predictor that become columns; the driver solves systems of the terms' number.
MOST_LEVELS = 2000


def design(df: DataFrame, predictors: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Double columns x0.. with a constant first; strings become indicators of all levels but the
    first in sorted order. Returns the frame with an array column `x` and the term names."""
    terms, cols = ["const"], [F.lit(1.0)]
    for p in predictors:
        if text_like(df, p):
            for lv in levels(df, p, MOST_LEVELS)[1:]:
                terms.append(f"{p}_{lv}")
                cols.append(F.when(F.col(p) == lv, 1.0).otherwise(0.0))
        else:
            terms.append(p)
            cols.append(number(p))
    return df.withColumn("x", F.array(*cols)), terms
