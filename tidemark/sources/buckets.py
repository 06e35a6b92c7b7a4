"""Tables that upserts write to: rows by hash of their key in bucket folders, of which an upsert rewrites those it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """A Parquet table under path, in `buckets` folders by hash of the keys.

    An upsert writes the new content of the touched buckets beside the table, then puts it in their place,
    then notes its id. Run again with its id, it goes on where it stopped: what was noted is not done
    again, what was written beside is not computed again, so even sums are added once. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, name: str, mode: str = "dynamic") -> None:
        """dynamic: buckets that df has are replaced, others stay. static: all is replaced, and _SUCCESS shows that it is whole."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(min(n, self.buckets), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/{name}")

    def create(self, df: DataFrame) -> BucketTable:
        """Writes a new table; keys should be unique, a null key is a key."""
        self._remove("")
        self._write(self._bucketed(df), "rows", "static")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        return self

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: other folders are not opened."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        rows = self.spark.read.schema(schema.add("bucket", T.IntegerType())).parquet(f"{self.path}/rows")
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def upsert(self, news: DataFrame, write_id: str, merge: Merge) -> list[int]:
        """Merges news in, whose columns the merge decides about: (old rows of the touched buckets, news) -> their new rows. Returns the touched buckets.

        A merge may add rows with keys of news, change rows and leave rows out; it keeps the table's columns.
        """
        if self._has(f"log/{write_id}"):
            return []
        news, staged = self._bucketed(news), f"staged/{write_id}"
        touched = sorted(r.bucket for r in news.select("bucket").distinct().collect())  # at most as many as buckets
        if not self._has(f"{staged}/_SUCCESS"):
            self._remove(staged)
            merged = merge(self.read(touched).drop("bucket"), news.drop("bucket"))
            self._write(self._bucketed(merged), staged, "static")
        self._swap(staged, touched)
        self._fs.create(self._path(f"{self.path}/log/{write_id}"), True).close()
        self._remove(staged)
        return touched

    def _swap(self, staged: str, touched: Sequence[int]) -> None:
        """The staged buckets in the table's place; doing it twice changes nothing more."""
        schema = self.read().schema
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{staged}")
        self._write(rows, "rows")
        for b in touched:
            if not self._has(f"{staged}/bucket={b}"):
                self._remove(f"rows/bucket={b}")
