"""Exact, linearly interpolated quantiles of groups of any size.

The percentile aggregate gathers all distinct values of a group in one task. Here values are counted
first, by group and value, so that a large group is spread over all tasks. Each group's different values
are cut into STEPS steps of about as many of them each, whatever their distribution (the cuts are
approximate quantiles, which hold bounded memory and combine before the shuffle). Exact counts of the
steps tell in which of them each wanted rank lies; those with over MOST different values are cut again, and only
the last round's values are put in order. A round keeps a share of 1 in STEPS or so of the values for each rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Steps that a part is cut into; a power of two.
STEPS = 128
#: Different values that one task puts in order; steps of more are cut again.
MOST = 1 << 20


def quantiles(df: DataFrame, keys: Sequence[str], column: str, points: Mapping[str, float]) -> DataFrame:
    """(keys, a column for each point): quantiles of column over each key's rows; of all rows without keys.

    Nulls and NaN don't count; keys without any value have no row. Null keys are a group. Without keys and values
    there is one row of nulls.
    """
    return quantiles_of_counts(value_counts(df, keys, column), keys, points)


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(_k0, _k1 .. for the keys, _v, _n): how often each key has each value; nulls and NaN don't count.

    Stored, as quantiles read it four times: the rows before it are read and counted once.
    """
    values = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("_v")).where("_v is not null")
    return stored(values.groupBy(*[f"_k{i}" for i in range(len(keys))], "_v").agg(F.count("*").alias("_n")))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """quantiles, from the rows of value_counts."""
    ks = [f"_k{i}" for i in range(len(keys))]

    def joined(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """left with right's columns, of the same keys; null matches null."""
        on = [*ks, *more]
        r = right.withColumnsRenamed({k: f"{k}_r" for k in on})
        if not on:
            return left.join(F.broadcast(r), F.lit(True))
        return left.join(r, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on]).drop(*[f"{k}_r" for k in on])

    def before(*by: str, order: str) -> Column:
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def wanted(at: Column) -> Column:
        """Whether the places from at on, _n of them, have a rank that a point needs."""
        out = F.lit(False)
        for p in points.values():
            place = (F.col("_all") - 1) * p
            out = out | ((at <= F.ceil(place)) & (at + F.col("_n") > F.floor(place)))
        return out

    # Each round cuts the parts in which wanted ranks lie; the first part of a group is all of it.
    parts = counts.withColumns({"_part": F.lit("").cast("string"), "_start": F.lit(0).cast("bigint")})
    while True:
        # Stored: approximate quantiles depend on the order in which tasks' results come, so taken twice they may differ.
        ends = stored(parts.groupBy(*ks, "_part").agg(F.percentile_approx("_v", [i / STEPS for i in range(1, STEPS)], 16 * STEPS).alias("_cuts"), *[F.sum("_n").alias("_all")] * ("_all" not in parts.columns)))
        # The number of cuts below a value, by halving: STEPS - 1 cuts take one comparison for each of its bits.
        halves = F.array(*[F.lit(1 << i) for i in reversed(range(STEPS.bit_length() - 1))])
        step = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get("_cuts", at + half - 1) < F.col("_v"), half).otherwise(F.lit(0)))
        stepped = joined(parts, ends, "_part").withColumn("_step", step)
        stepped = stepped.withColumn("_part", F.concat_ws(".", "_part", F.col("_step").cast("string"))).select(*ks, "_part", "_v", "_n", "_all", "_start")
        histogram = stepped.groupBy(*ks, "_part").agg(F.sum("_n").alias("_n"), F.max("_all").alias("_all"), F.max("_start").alias("_start"), F.min("_v").alias("_least"), F.count("*").alias("_values"))
        histogram = histogram.withColumn("_upper", F.regexp_replace("_part", r"\.?[0-9]+$", "")).withColumn("_before", F.col("_start") + before(*ks, "_upper", order="_least"))
        steps = stored(histogram.where(wanted(F.col("_before"))).select(*ks, "_part", "_before", "_values"))
        parts = joined(stepped.drop("_start"), steps, "_part").withColumnRenamed("_before", "_start")
        if (steps.agg(F.max("_values")).first()[0] or 0) <= MOST:
            break
        parts = stored(parts.drop("_values"))
    placed = parts.withColumn("_at", F.col("_start") + before(*ks, "_part", order="_v"))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("_at") <= rank) & (F.col("_at") + F.col("_n") > rank), F.col("_v")))

    out = {}
    for i, p in enumerate(points.values()):
        place = (F.col("_all") - 1) * p
        out |= {f"_lo{i}": value(F.floor(place)), f"_hi{i}": value(F.ceil(place)), f"_part{i}": F.max(place - F.floor(place))}
    got = placed.groupBy(*ks).agg(*[x.alias(n) for n, x in out.items()])
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(n) for i, n in enumerate(points)]
    return got.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], *between)


def quantiles_of(df: DataFrame, keys: Sequence[str], points: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(keys, a column for each point): quantiles of several columns in one pass, points being column -> name -> share.

    Rows become one row for each column, so the columns are groups of one table.
    """
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(points)]))
    shares = sorted({x for names in points.values() for x in names.values()})
    found = quantiles(df.select(*keys, each), [*keys, "_of"], "_value", {f"_p{i}": x for i, x in enumerate(shares)})
    picked = [F.max(F.when(F.col("_of") == i, F.col(f"_p{shares.index(x)}"))).alias(name) for i, names in enumerate(points.values()) for name, x in names.items()]
    return found.groupBy(*keys).agg(*picked)


def with_quantiles_of(df: DataFrame, keys: Sequence[str], points: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """df with its keys' quantiles of several columns; null where a key has no value."""
    got = quantiles_of(df, keys, points).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return df.join(got, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])


def with_quantiles(df: DataFrame, keys: Sequence[str], column: str, points: Mapping[str, float]) -> DataFrame:
    """df with its keys' quantiles of column; null where a key has no value."""
    got = quantiles(df, keys, column, points)
    if not keys:
        return df.join(F.broadcast(got), F.lit(True), "left")
    got = got.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return df.join(got, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])
