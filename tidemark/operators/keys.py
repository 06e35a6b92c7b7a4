"""Rows by key: latest of each, unions in which one side wins, upserts and updates by rewriting, key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in this order, which should be total; null keys form one key.

    As the row number is only compared with 1, Spark keeps each task's first row of a key before the
    shuffle (WindowGroupLimit), so a hot key sends one row from each task.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_keep(old: DataFrame, new: DataFrame, keys: Sequence[str], prefer: str = "old") -> DataFrame:
    """Both tables' rows, one for each key: the preferred table's. Within a table keys should be unique."""
    first, second = (old, new) if prefer == "old" else (new, old)
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return best_per_key(both, keys, F.col("_side")).drop("_side")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys that new has, and new: what a MERGE that replaces rows gives. Null keys match null keys."""
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).alias("n"), match, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upserted_filling(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key of either: old's value of a column where it isn't null or '', else new's."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = o.join(n, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(F.when(F.col(f"_o_{c}").cast("string") != "", F.col(f"_o_{c}")), F.col(f"_n_{c}")).alias(c) for c in columns])


def updated(df: DataFrame, news: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """df with columns[c] of news, where that isn't null, in place of c. news has each key once."""
    n = news.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_v_{c}") for c, v in columns.items()])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    out = df.join(n, on, "left").withColumns({c: F.coalesce(f"_v_{c}", c) for c in columns})
    return out.drop(*[f"_k_{k}" for k in keys], *[f"_v_{c}" for c in columns])


def single_active(df: DataFrame, key: str, value: Column, flag: str = "is_active") -> DataFrame:
    """The flag is 1 for the row of this key and 0 for all others."""
    return df.withColumn(flag, F.when(F.col(key) == value, 1).otherwise(0))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def is_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no row has a null key and no two rows the same."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return df.where(some_null).isEmpty() and repeated_keys(df, keys).isEmpty()


def max_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables with different columns, one row for each key, of each column the largest value."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def priority_union(lists: Sequence[DataFrame], key: Sequence[str], most: int, per: Sequence[str] = ()) -> DataFrame:
    """Rows of ranked lists (with column place) one list after another, repeats of a key dropped, the first `most` for each `per`.

    Adds focus_place, from 1.
    """
    both = lists[0].withColumn("_list", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        both = both.unionByName(x.withColumn("_list", F.lit(i)))
    once = best_per_key(both, [*per, *key], F.col("_list"), F.col("place"))
    w = Window.partitionBy(*per).orderBy("_list", "place")
    return once.withColumn("focus_place", F.row_number().over(w)).where(F.col("focus_place") <= most).drop("_list")


def soft_match(df: DataFrame, keys: Sequence[str], tiers: Sequence[Column], *order: Column) -> DataFrame:
    """For each key the best row: conditions are tried from the first on, one that would leave no row is passed over."""
    return best_per_key(df, keys, *[F.coalesce(c, F.lit(False)).desc() for c in tiers], *order)
