"""The registry of named queries: name -> function of (spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("series_queries", "error_queries", "table_queries", "quality_queries", "text_queries", "retrieval_queries", "model_queries", "source_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under name, with its check SQL if there is any."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
