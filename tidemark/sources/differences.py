"""Where two copies of a table differ: hashes of ranges of keys, compared level by level down to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Bits of a key's hash that each level of the tree tells apart.
LEVELS = (8, 14)


def differences(source: DataFrame, target: DataFrame, keys: Sequence[str], levels: Sequence[int] = LEVELS) -> tuple[DataFrame, list[int]]:
    """((keys, kind, n_source, n_target), rows compared by level): the keys with other rows, kind being lost, added or changed.

    All columns that both have are compared, as text. Rows lie in a tree by the hash of their key; each
    level adds up the row hashes of the ranges that differ on the level above, 2**bits rows of sums at
    most, and only rows of ranges that still differ are compared by key. Keys may repeat: rows of a key are a bag.
    Null keys match.
    """
    common = [c for c in source.columns if c in target.columns]
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in common])

    def hashed(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys]), 32).alias("_at"), row.alias("_row"))

    def narrowed(df: DataFrame, bits: int, ranges: DataFrame | None) -> DataFrame:
        return df if ranges is None else df.join(F.broadcast(ranges), F.shiftright(F.col("_at"), 32 - bits) == F.col("_range"), "left_semi")

    sides, ranges, above, compared = [hashed(source), hashed(target)], None, 0, []
    for bits in levels:
        sums = []
        for side in sides:
            wide = F.sum(F.col("_row").cast("decimal(20,0)"))
            sums.append(narrowed(side, above, ranges).groupBy(F.shiftright(F.col("_at"), 32 - bits).alias("_range")).agg(F.count("*").alias("n"), wide.alias("h")))
        a, b = sums
        both = stored(a.alias("a").join(b.alias("b"), "_range", "full_outer").select("_range", F.coalesce("a.n", F.lit(0)).alias("n"), F.coalesce("b.n", F.lit(0)).alias("m"), F.expr("a.n <=> b.n and a.h <=> b.h").alias("same")))
        compared.append(both.agg(F.coalesce(F.sum(F.col("n") + F.col("m")), F.lit(0))).first()[0])
        ranges, above = both.where("not same").select("_range"), bits  # 2**bits numbers at most
    rows = [narrowed(side, above, ranges).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_row").cast("decimal(20,0)")).alias("h")) for side in sides]
    names = [f"_k{i}" for i in range(len(keys))]
    a, b = (r.toDF(*names, "n", "h") for r in rows)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]
    met = stored(a.alias("a").join(b.alias("b"), on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(c) for k, c in zip(names, keys, strict=True)], F.coalesce("a.n", F.lit(0)).cast("long").alias("n_source"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n_target"), F.expr("a.h <=> b.h").alias("same")))
    compared.append(met.agg(F.coalesce(F.sum(F.col("n_source") + F.col("n_target")), F.lit(0))).first()[0])
    kind = F.when(F.col("n_target") == 0, "lost").when(F.col("n_source") == 0, "added").otherwise("changed")
    return met.where("not same or n_source != n_target").select(*keys, kind.alias("kind"), "n_source", "n_target"), compared
