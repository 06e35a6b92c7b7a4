"""Intermediate tables in the folder that driver and executors share, removed as the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh name in a folder of the application under spark.checkpoint.dir; under a temporary folder where that is unset, in local mode alone."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-tidemark-")
        _ROOTS[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    """Removes path; where the session has gone already, the cluster's own cleaning of the folder does."""
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and reread: what reads it does not compute it again."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
