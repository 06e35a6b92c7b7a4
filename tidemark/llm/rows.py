"""Rows of a table whose columns may have any names: by place, so that no name can clash with an operator's own or differ by case alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LAST = 2**63 - 1


def place(docs: DataFrame, name: str) -> int:
    """Where docs has the column: the first of just this name, else the first whose name differs by case."""
    lower = [c.lower() for c in docs.columns]
    if name in docs.columns:
        return docs.columns.index(name)
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} among {docs.columns}")


def picked(docs: DataFrame, **names: str) -> DataFrame:
    """The columns of docs that the values name, under the keys' names."""
    by_place = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return by_place.select(*[F.col(f"_{place(docs, c)}").alias(k) for k, c in names.items()])


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): row is a struct of all columns but the text, named by their places."""
    text = place(docs, text_col)
    by_place = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    others = [F.col(f"_{i}") for i in range(len(docs.columns)) if i != text]
    return by_place.select(F.struct(*others or [F.lit(None).cast("int").alias("_")]).alias("row"), F.col(f"_{text}").cast("string").alias("text"))


def unpacked(out: DataFrame, docs: DataFrame, text_col: str, report: str | None = None, text: bool = True) -> DataFrame:
    """The columns of docs in their order from (row, text), without the text if text is false; then out's column `report`.

    The report is the last column. It keeps its name unless docs has one like it, in upper or lower
    case: then a number follows.
    """
    at = place(docs, text_col)
    own = [(F.col("text") if i == at else F.col("row").getField(f"_{i}")).alias(c) for i, c in enumerate(docs.columns) if text or i != at]
    return out.select(*own, *[F.col(x).alias(free(docs, x)) for x in [report] if x])


def free(docs: DataFrame, name: str) -> str:
    """The name, or the name with the first number after it, that no column of docs has in upper or lower case."""
    taken, number = {c.lower() for c in docs.columns}, 0
    while (name + str(number or "")).lower() in taken:
        number += 1
    return name + str(number or "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sub, text, row): id orders documents, null last; sub is 0, or a hash of the text where an id repeats.

    row holds all columns but the text.
    """
    row = packed(docs, text_col).withColumn("id", F.coalesce(F.col("row").getField(f"_{place(docs, id_col)}").cast("long"), F.lit(_LAST)))
    repeated = row.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))
    if repeated.isEmpty():
        return row.withColumn("sub", F.lit(0).cast("long"))
    return row.join(repeated, "id", "left").withColumn("sub", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("again")
