"""Queries that train a baseline on the hourly series. SQL can't say them; tests hold them against plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines as b
from ..operators.metrics import regression_figures, time_split
from ..operators.series import hourly, with_lags, with_rolling
from .registry import query, table

_FEATURES = ["price_lag_1", "price_lag_24", "load_lag_24", "price_roll_mean_24"]


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    hours = with_lags(hours, "event_type", "hour_ts", {"price": [1, 24], "load": [24]})
    return time_split(with_rolling(hours, "event_type", "hour_ts", ["price"], [24]), "event_type", "hour_ts", 7)


@query("linear_baseline")
def linear_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _prepared(spark, sf_dir)
    model = b.fit(data.where("part = 'train'"), _FEATURES, "price")
    return regression_figures(b.predicted(model, data.where("part = 'test'"), _FEATURES), ["event_type"], "predicted", "price")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _prepared(spark, sf_dir)
    return b.importances(b.fit(data.where("part = 'train'"), _FEATURES, "price", "forest"), _FEATURES, spark)
