"""Writers: tables, files, idempotent reruns, growing schemas, run registries, copy checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite
from ..operators.keys import is_key


def flat(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text, timestamps without zone: what a flat table or file can hold."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def json_rows(df: DataFrame) -> DataFrame:
    """(json): each row as JSON, NaN and infinities as null, times in ISO form, null fields kept."""
    safe = [finite(f"`{c}`").alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))


def write_table(df: DataFrame, name: str, mode: str = "append") -> None:
    """Appends to, or replaces ('overwrite'), a catalog table."""
    df.write.mode(mode).format("parquet").saveAsTable(name)


def write_files(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """CSV with a header, JSON lines or Parquet, a file for each partition. CSV gets complex columns as JSON."""
    if kind == "csv":
        flat(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def write_partition(df: DataFrame, path: str, key: str) -> None:
    """Replaces, under path, the rows of the key values that df has, and no others: a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def matching(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Just the columns of the target that df has, in the target's order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def append_growing(df: DataFrame, path: str) -> None:
    """Appends rows with new columns; older rows read as null there. Read it with read_growing."""
    df.write.mode("append").parquet(path)


def read_growing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def import_run(tables: Mapping[str, DataFrame], run_id: str, mode: str, started_at: str, prefix: str = "") -> DataFrame:
    """Appends each table with run columns and returns the registry: (run_id, table_name, n_rows)."""
    registry = None
    for name, df in tables.items():
        spark = df.sparkSession
        stamped = df.withColumns({"run_id": F.lit(run_id), "run_mode": F.lit(mode), "run_started_at": F.lit(started_at).cast("timestamp_ntz"), "source_name": F.lit(name)})
        write_table(stamped, prefix + name)
        one = spark.table(prefix + name).where(F.col("run_id") == run_id).agg(F.lit(run_id).alias("run_id"), F.lit(prefix + name).alias("table_name"), F.count("*").alias("n_rows"))
        registry = one if registry is None else registry.unionByName(one)
    return registry


def copy_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: n_source, n_target, same. Compares counts and an order-free sum of row hashes over common columns."""
    common = [c for c in source.columns if c in target.columns]

    def figures(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in common]).cast("decimal(20,0)")
        return df.agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.sum(h), F.lit(0)).alias(f"h_{name}"))

    both = figures(source, "source").join(figures(target, "target"), F.lit(True))
    return both.select("n_source", "n_target", (F.expr("n_source = n_target and h_source = h_target")).alias("same"))


def key_of(df: DataFrame, candidates: Sequence[Sequence[str]]) -> list[str] | None:
    """The first candidate whose columns df has and that is a key of it; None if there is none."""
    for c in candidates:
        if all(x in df.columns for x in c) and is_key(df, c):
            return list(c)
    return None


def with_key(df: DataFrame, candidates: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """df and its key; where it has none, an id by hash of the row and place among equal rows is added."""
    found = key_of(df, candidates)
    if found:
        return df, found
    from pyspark.sql import Window

    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    again = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
    keyed = df.withColumn("_h", h).withColumn("row_id", F.concat_ws("-", F.hex("_h"), again.cast("string"))).drop("_h")
    return keyed, ["row_id"]


def create_views(views: Mapping[str, tuple[Sequence[str], str]], spark: SparkSession) -> list[str]:
    """Creates each view (name -> tables it needs, SQL) whose tables all exist; returns the names of those."""
    made = []
    for name, (needs, sql) in views.items():
        if all(spark.catalog.tableExists(t) for t in needs):
            spark.sql(sql).createOrReplaceTempView(name)
            made.append(name)
    return made
