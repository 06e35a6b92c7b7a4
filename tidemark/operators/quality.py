"""Data quality: column profiles, exact descriptions, coverage, freshness, reports over several tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import exact_mean
from .quantiles import quantiles


def _unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text): a row for each value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, data_type, n_rows, n_null, null_percent, n_distinct) for each column, exactly.

    One pass: values are unpivoted and counted by (column, value), so each column's distinct values
    spread over all tasks. An empty table has rows of zeros for its columns.
    """
    columns = list(columns or df.columns)
    counts = _unpivot(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    figures = counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct")
    )
    types = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in columns], "column_name string, data_type string")
    out = types.join(figures, "column_name", "left").fillna(0, ["n_rows", "n_null", "n_distinct"])
    share = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows") * 100).otherwise(0.0)
    return out.select("column_name", "data_type", "n_rows", "n_null", F.round(share, 6).alias("null_percent"), "n_distinct")


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, std, least, p25, p50, p75, most) of numeric columns; exact quantiles. Nulls and NaN don't count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    out = long.groupBy("column_name").agg(F.count("x").alias("n"), exact_mean("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))
    return out.join(quantiles(long, ["column_name"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column_name", "left")


def coverage(df: DataFrame, name: str, ts: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: table_name, n_rows, n_columns, n_duplicate_rows, n_missing, least_ts, most_ts. Rows are equal if all columns are.

    Equal rows are counted first, by all columns; complex columns take part as JSON.
    """
    columns = list(columns or df.columns)
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{c}`") for c in columns])
    rows = flat.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("_n"))
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return rows.agg(
        F.lit(name).alias("table_name"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit(len(columns)).alias("n_columns"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicate_rows"),
        F.coalesce(F.sum(missing * F.col("_n")), F.lit(0)).alias("n_missing"), F.min(ts).alias("least_ts"), F.max(ts).alias("most_ts"),
    )


def freshness(df: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """One row: table_name, n_rows, least_ts, most_ts, n_missing (null times and null values, each counted)."""
    return df.agg(
        F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.min(ts).cast("timestamp_ntz").alias("least_ts"), F.max(ts).cast("timestamp_ntz").alias("most_ts"),
        (F.count(F.when(F.col(ts).isNull(), 1)) + F.count(F.when(F.col(value).isNull(), 1))).alias("n_missing"),
    )


def quality_report(tables: Mapping[str, tuple[DataFrame, str, str, Sequence[str]]]) -> DataFrame:
    """Freshness of several tables (name -> table, time, value and key columns) with rates, scores and a status.

    missing_rate counts times and values, so it can pass 100; duplicate_rate is the share of rows whose
    key another row has before them. Empty tables are 'empty', those with a missing rate 'incomplete', others 'ok'.
    """
    out = None
    for name, (df, ts, value, keys) in tables.items():
        again = df.groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_again"))
        one = freshness(df, name, ts, value).join(F.broadcast(again), F.lit(True))
        out = one if out is None else out.unionByName(one)
    n, rate = F.col("n_rows"), F.round(F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows") * 100).otherwise(0.0), 4)
    status = F.when(n == 0, "empty").when(F.col("missing_rate") > 0, "incomplete").otherwise("ok")
    out = out.withColumn("missing_rate", rate).withColumn("duplicate_rate", F.round(F.when(n > 0, F.col("n_again") / n * 100).otherwise(0.0), 4))
    return out.withColumns({"freshness_score": F.when(F.col("most_ts").isNotNull(), 100).otherwise(60), "pass_rate": 100 - F.least(F.col("missing_rate"), F.lit(100.0)), "status": status}).drop("n_again")


def top_counts(df: DataFrame, keys: Sequence[str], column: str, most: int = 5) -> DataFrame:
    """Each key's commonest values with their number and place; of equally common ones the smaller value first."""
    from .risk import ranked

    return ranked(df.groupBy(*keys, column).agg(F.count("*").alias("n")), keys, most, F.desc("n"), F.col(column))


def matches_any(df: DataFrame, columns: Sequence[str], word: str) -> Column:
    """Whether word stands in any of the columns, case ignored; % and _ are ordinary."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(word.lower()))
    return F.coalesce(out, F.lit(False))


def page(df: DataFrame, columns: Sequence[str], word: str, key: str, size: int, number: int) -> DataFrame:
    """One page of the rows with word in any of the columns, by key, each with n_total, the number of all such rows.

    The page is a top-k of size * (number + 1) rows; rows before it are not returned.
    """
    hits = df.where(matches_any(df, columns, word)) if word else df
    total = hits.agg(F.count("*").alias("n_total"))
    return hits.orderBy(key).offset(size * number).limit(size).join(F.broadcast(total), F.lit(True))


def catalog_columns(tables: Mapping[str, DataFrame]) -> list[tuple[str, int, str]]:
    """(table, number of columns, first column names) from schemas alone."""
    return [(n, len(t.columns), ", ".join(t.columns[:12])) for n, t in sorted(tables.items())]
