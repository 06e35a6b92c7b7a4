"""Streams of events: hourly figures with late data, and repeats dropped within a time limit. An addition: the batch operators are in operators.series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, key: str, ts: str, value: str, late: str = "3 days") -> DataFrame:
    """(key, hour_ts, price, load) of each hour, once it can't change any more; events later than `late` are not counted."""
    t = F.col(ts).cast("timestamp")
    grouped = events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", "1 hour").alias("_w"), key)
    out = grouped.agg((F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count(value)).alias("price"), F.count("*").alias("load"))
    return out.select(key, F.col("_w.start").cast("timestamp_ntz").alias("hour_ts"), "price", "load")


def first_of_each(events: DataFrame, keys: list[str], ts: str, within: str = "3 days") -> DataFrame:
    """The first row of each key to arrive, keys remembered for `within`: the stream's form of a union in which old rows win."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
