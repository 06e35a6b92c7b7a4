"""Hourly series: grid, lags, rolling figures, as-of picks and comparisons with other days.

Every window is partitioned by the series' key. A series has a row for each hour, so one key's rows
grow with time, not with the number of raw events, which are summed up before any window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_of, exact_mean, hour_of


def hourly(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, hour_ts, price, load): mean value and number of events of each hour that has any.

    Rows without a time are left out; price is null where an hour has no value.
    """
    return events.where(F.col(ts).isNotNull()).groupBy(key, hour_of(ts).alias("hour_ts")).agg(exact_mean(value).alias("price"), F.count("*").alias("load"))


def standardized(df: DataFrame, ts: str, *rest: str, keep: str = "first") -> DataFrame:
    """Rows with a readable time, one for each time: of repeated ones the first (or last) by the rest columns, or by all columns."""
    order = [F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_last() for c in rest or df.columns]
    ranked = df.where(F.col(ts).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(ts).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def with_lags(df: DataFrame, key: str, order: str, lags: Mapping[str, Sequence[int]]) -> DataFrame:
    """Adds <column>_lag_<k>: the value k rows (not hours) before; null at a series' start."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c, ks in lags.items() for k in ks})


def with_rolling(df: DataFrame, key: str, order: str, columns: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Adds <column>_roll_{mean,std,min,max}_<w> over the w rows before the row; null unless all w have a value."""
    out = {}
    for c in columns:
        for n in windows:
            w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
            full = F.count(c).over(w) == n
            exact = F.col(c).cast("decimal(28,12)")
            figures = {"mean": F.sum(exact).over(w).cast("double") / n, "std": F.stddev_samp(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w)}
            out |= {f"{c}_roll_{name}_{n}": F.when(full, x) for name, x in figures.items()}
    return df.withColumns(out)


def with_step(df: DataFrame, key: str, order: str, column: str, name: str = "abs_step") -> DataFrame:
    """Adds the absolute difference to the row before; null for a series' first row."""
    return df.withColumn(name, F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(key).orderBy(order))))


def day_ahead_vintage(forecasts: DataFrame, keys: Sequence[str], target: str, made: str, tie: str) -> DataFrame:
    """For each (keys, target) the last forecast made on the day before it; failing that, the last made before the target.

    Forecasts made at or after their target, or without a time, never count; a target with no other is
    left out. tie decides among forecasts made at the same time, the largest first.
    """
    before = day_of(made) == F.date_sub(day_of(target), 1)
    usable = forecasts.where(before | (F.col(made) < F.col(target)))
    w = Window.partitionBy(*keys, target).orderBy(before.desc(), F.col(made).desc(), F.col(tie).desc())
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_same_hour_before(df: DataFrame, key: str, ts: str, value: str, days: Sequence[int]) -> DataFrame:
    """Adds <value>_<d>d: the value at the same hour d days before (by time, not by row); null if there is none."""
    out = df
    for d in days:
        past = df.select(F.col(key).alias("_k"), (F.col(ts) + F.expr(f"INTERVAL {d} DAYS")).alias("_t"), F.col(value).alias(f"{value}_{d}d"))
        out = out.join(past, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_t")), "left").drop("_k", "_t")
    return out


def gap_counts(df: DataFrame, key: str, ts: str, most: int = 3) -> DataFrame:
    """(key, gap_seconds, n, place): each series' commonest distances between rows; of equally common ones the shorter first."""
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(Window.partitionBy(key).orderBy(ts)).cast("timestamp"))
    counts = df.select(key, gap.alias("gap_seconds")).where("gap_seconds is not null").groupBy(key, "gap_seconds").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "gap_seconds"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def complete_until(df: DataFrame, ts: str, sources: Mapping[str, Column]) -> DataFrame:
    """Rows up to the earliest of the sources' latest times; a source's condition says which rows have it.

    If a source has no row at all, no row is left.
    """
    tops = df.agg(*[F.max(F.when(c, F.col(ts))).alias(n) for n, c in sources.items()])
    # least() skips nulls, so a source without rows is checked for.
    ends = tops.select(F.when(F.greatest(*[F.col(n).isNull() for n in sources]), F.lit(None)).otherwise(F.least(*[F.col(n) for n in sources])).alias("_end"))
    return df.join(F.broadcast(ends), F.col(ts) <= F.col("_end")).drop("_end")


def resume_from(df: DataFrame, ts: str, floor: Column, days: int = 3) -> DataFrame:
    """(start_ts): some days before the last row, but not before floor; floor for an empty table."""
    last = F.max(ts) - F.expr(f"INTERVAL {days} DAYS")
    return df.agg(F.coalesce(F.greatest(last, floor), floor).alias("start_ts"))


def filled_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Nulls of df's columns filled from other's row of that key; was_filled tells if any was."""
    theirs = other.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(theirs, F.col(key) == F.col("_k"), "left")
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.col(c).isNull() & F.col(f"_{c}").isNotNull())
    joined = joined.withColumn("was_filled", filled)
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_k", *[f"_{c}" for c in columns])
