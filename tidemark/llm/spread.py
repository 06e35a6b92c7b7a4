"""Lookups by keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: A key with more than one row in PARTS is hot, so fewer than PARTS keys are.
PARTS = 1000


def looked_up(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """left with struct `found`: the other columns of right's row for the key columns `on`, null where it has none.

    right has at most one row for each key. The rows of hot keys, fewer than PARTS, are broadcast. In the
    join that serves all other keys, left's rows with hot keys are dealt by all their columns, so no task
    gets a hot key's rows together, and nothing that grows with the input is broadcast. left is read
    twice or more, so it should be stored. counts: (on, n) with the rows of each key that right has, if
    the caller knows them.
    """
    if counts is None:
        counts, every = left.groupBy(*on).agg(F.count("*").alias("n")), left.count()
    else:
        every = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = stored(counts.where(F.col("n") * PARTS > every).select(*on))
    values = F.struct(*[c for c in right.columns if c not in on])
    known = right.join(F.broadcast(hot), on, "left_semi").select(*on, values.alias("_hot"))
    known = stored(hot.join(known, on, "left").select(*on, "_hot", F.lit(True).alias("_is_hot")))
    dealt = left.join(F.broadcast(known), on, "left")
    dealt = dealt.withColumn("_deal", F.when(F.col("_is_hot"), F.xxhash64(*left.columns)).otherwise(F.xxhash64(*on)))
    rest = right.select(*on, F.xxhash64(*on).alias("_deal"), values.alias("_cold"))
    return dealt.join(rest, [*on, "_deal"], "left").select(*left.columns, F.coalesce("_hot", "_cold").alias("found"))
