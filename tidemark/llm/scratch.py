"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of spark.checkpoint.dir, or of a temporary folder where that is unset (tests, local mode)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-tidemark-")
        _ROOTS[app] = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    """Tidies up as the driver ends; a session that has gone already leaves the folder to the cluster's own cleaning."""
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and reread: cuts the lineage, so lost executors never recompute what lies before."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Sets the session's limit on the bytes of an Arrow batch, unless it has one other than Spark's 64 MB, so that batches of long texts stay small."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
