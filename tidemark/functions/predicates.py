"""Filters put together at plan time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, conditions: Mapping[str, tuple[object, Column]]) -> DataFrame:
    """df under those conditions (name -> value, condition) whose value is given: neither None nor ''."""
    for value, condition in conditions.values():
        if value not in (None, ""):
            df = df.where(condition)
    return df


def between_days(df: DataFrame, ts: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Rows of the days from first to last, both whole; an open end for None."""
    if first is not None:
        df = df.where(F.col(ts) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        df = df.where(F.col(ts) < F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return df


def day_or_last(df: DataFrame, key: str, ts: str, day: dt.date, rows: int = 24) -> DataFrame:
    """Each key's rows of the day; the last `rows` rows of a key that has none on it."""
    on_day = F.to_date(ts) == F.lit(day)
    ranked = df.withColumns({"_any": F.max(F.coalesce(on_day, F.lit(False))).over(Window.partitionBy(key)), "_n": F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last()))})
    return ranked.where(F.when(F.col("_any"), on_day).otherwise(F.col("_n") <= rows)).drop("_any", "_n")


def holds_on(day: Column, starts: Column, ends: Column) -> Column:
    """Whether a validity interval with open ends (null) holds on the day."""
    return (starts.isNull() | (starts <= day)) & (ends.isNull() | (ends >= day))
