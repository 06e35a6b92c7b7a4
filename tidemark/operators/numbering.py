"""Row numbers, ranks and pages over a whole table, without a window that gathers it in one task.

Rows are dealt to ordered slices by ranges of their sort keys and numbered in their slice; the slices'
sizes, one row each, are added up and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

_ROW = "monotonically_increasing_id() & 8589934591"


def sliced(df: DataFrame, order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """df with _slice, in the order of the keys, and _row, from 0 in each slice. Rows with all keys equal share a slice."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Number and slice are taken where the rows are sorted and are written with them.
    return stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_slice"), F.expr(_ROW).alias("_row")))


def _before(rows: DataFrame) -> dict[int, int]:
    """Rows before each slice."""
    out, total = {}, 0
    for r in rows.groupBy("_slice").agg(F.count("*").alias("n")).orderBy("_slice").collect():
        out[r["_slice"]], total = total, total + r.n
    return out


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", slices: int | None = None) -> DataFrame:
    """df with the number, from 1, that each row has in this order, which should be total."""
    rows = sliced(df, order, slices)
    before = df.sparkSession.createDataFrame(list(_before(rows).items()), "_slice int, _before long")
    return rows.join(F.broadcast(before), "_slice").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_slice", "_before", "_row")


def ranked_all(df: DataFrame, value: str, name: str = "rank", descending: bool = True, slices: int | None = None) -> DataFrame:
    """df with each row's rank by one column: the number of its first equal, from 1; nulls come last, and are equal.

    A value of any share of the rows is spread over slices by a hash of the whole row; a slice that begins
    with the last value of the one before takes that value's rank from it.
    """
    key = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    rows = sliced(df.withColumn("_deal", F.xxhash64(*df.columns)), [key, "_deal"], slices)
    firsts = stored(rows.groupBy("_slice", F.col(value).alias("_value")).agg(F.min("_row").alias("_first")))
    ends = rows.groupBy("_slice").agg(F.count("*").alias("n"), F.struct(F.min_by(value, "_row").alias("v")).alias("low"), F.struct(F.max_by(value, "_row").alias("v")).alias("high"))
    last = firsts.groupBy("_slice").agg(F.max("_first").alias("last"))
    carried, total, rank, value_before = [], 0, 0, None
    for r in ends.join(last, "_slice").orderBy("_slice").collect():
        follows = value_before == r.low
        carried.append((r["_slice"], total, rank if follows else None))
        # The last value of this slice has its first row here, unless the slice is all of the value before.
        if not (follows and r.last == 0):
            rank = total + r.last + 1
        total, value_before = total + r.n, r.high
    known = df.sparkSession.createDataFrame(carried, "_slice int, _before long, _carried long")
    ranks = firsts.join(F.broadcast(known), "_slice").select("_slice", "_value", F.when(F.col("_first") == 0, F.col("_carried")).alias("_c"), (F.col("_before") + F.col("_first") + 1).alias("_own"))
    ranks = ranks.select("_slice", "_value", F.coalesce("_c", "_own").alias(name))
    on = [F.col("r._slice") == F.col("k._slice"), F.col(f"r.{value}").eqNullSafe(F.col("k._value"))]
    return rows.alias("r").join(ranks.alias("k"), on).select(*[F.col(f"r.{c}") for c in df.columns], F.col(f"k.{name}"))


def ranked_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank", slices: int | None = None) -> DataFrame:
    """df with rank(), from 1, of each row among those of its keys in this order; null keys are a group.

    A window by keys and slice holds no more than a slice, however large the share of one key.
    """
    rows = sliced(df, [*keys, *order], slices)
    sizes = rows.groupBy("_slice", *keys).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    # Keys that lie in one slice alone have a row here, others one for each of their slices.
    before = sizes.select(F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(ahead, F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.rank().over(Window.partitionBy("_slice", *keys).orderBy(*order)))
    on = [F.col("_slice") == F.col("_s"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return own.join(before, on).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def write_paged(df: DataFrame, order: Sequence[Column | str], path: str, group_bytes: int = 1 << 20) -> None:
    """Writes df in this order with its row numbers, `number`, in row groups of about group_bytes, so that a page is found by its numbers' bounds."""
    rows = numbered(df, order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "number").sortWithinPartitions("number").write.option("parquet.block.size", group_bytes).parquet(path)


def page(paged: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of a table that write_paged wrote: only row groups with its rows are read, however far back it lies."""
    return paged.where(F.col("number").between((number - 1) * size + 1, number * size))


def haloed(df: DataFrame, order: Sequence[Column | str], before: int, size: int = 100_000) -> DataFrame:
    """df in blocks of `size` rows of this order, each with the last `before` rows of the block ahead: _block, _number and _copy.

    A window by _block, in the order of _number, sees for every row that is no copy the `before` rows
    ahead of it, over gaps in time and over blocks, so one endless series is many even tasks. Drop the
    copies after it. With series' keys first in the order, windows by _block and the keys do the same.
    """
    if before > size:
        raise ValueError("a block must hold the rows that the next one looks back to")
    rows = numbered(df, order, "_number").withColumn("_number", F.col("_number") - 1)
    own = F.expr(f"_number div {size}")
    reaches = F.when(F.col("_number") % size >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select("*", F.posexplode(reaches).alias("_copy", "_block")).withColumn("_copy", F.col("_copy") == 1)
