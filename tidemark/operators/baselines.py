"""Regression baselines with pyspark.ml: features chosen without leaks, models by preference, importances, artifacts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw columns that are only known afterwards, never features themselves; their lags may be.
BANNED = ("da_price", "actual_load", "rt_price")


def feature_list(df: DataFrame, banned: Sequence[str] = BANNED, keys: Sequence[str] = ("datetime",)) -> list[str]:
    """Numeric columns of df that are neither keys nor banned."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in banned and c not in keys]


def leak_report(df: DataFrame, banned: Sequence[str] = BANNED) -> DataFrame:
    """(column_name, is_banned) for each column."""
    return df.sparkSession.createDataFrame([(c, int(c in banned)) for c in df.columns], "column_name string, is_banned int")


def fit_chain(train: DataFrame, features: Sequence[str], label: str, kinds: Sequence[str] = ("boosted", "forest", "linear")) -> tuple[PipelineModel, str, dict[str, str]]:
    """The first kind of model that can be fitted, its name, and why those before it could not."""
    failed: dict[str, str] = {}
    for kind in kinds:
        try:
            return fit(train, features, label, kind), kind, failed
        except (PySparkException, Py4JJavaError, ValueError) as e:
            failed[kind] = str(e).splitlines()[0]
    raise ValueError(f"no model could be fitted: {failed}")


def fit(train: DataFrame, features: Sequence[str], label: str, kind: str = "linear", seed: int = 1) -> PipelineModel:
    """A model of this kind ('linear', 'boosted' or 'forest') on rows without nulls in features and label."""
    makers = {"linear": LinearRegression, "boosted": GBTRegressor, "forest": RandomForestRegressor}
    model = makers[kind](featuresCol="_features", labelCol=label, predictionCol="predicted", **({} if kind == "linear" else {"seed": seed}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(train.dropna(subset=[*features, label]))


def predicted(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(df.dropna(subset=list(features))).drop("_features")


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance, place) of a tree model, or of a linear one by absolute weight; ties by name."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = sorted(((f, float(v)) for f, v in zip(features, values, strict=True)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, v, i) for i, (f, v) in enumerate(rows, 1)], "feature string, importance double, place int")


def features_hash(features: Sequence[str]) -> str:
    return hashlib.sha256(json.dumps(list(features)).encode()).hexdigest()


def save(model: PipelineModel, path: str, spark: SparkSession, version: str, features: Sequence[str], figures: dict[str, float]) -> None:
    """The model and its manifest (version, features, their hash, figures) under path."""
    model.write().overwrite().save(f"{path}/model")
    manifest = spark.createDataFrame([(version, list(features), features_hash(features), json.dumps(figures, sort_keys=True))], "version string, features array<string>, features_hash string, figures string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    """The model and its manifest; an error if the manifest's features don't match their hash."""
    row = spark.read.schema("version string, features array<string>, features_hash string, figures string").json(f"{path}/manifest").first()
    if features_hash(row["features"]) != row["features_hash"]:
        raise ValueError(f"the manifest under {path} does not match its features")
    return PipelineModel.load(f"{path}/model"), row.asDict()


def blended(base: Column | str, peak: Column | str, share: float) -> Column:
    """share of the peak model's price, the rest of the base model's; the base's where the peak model has none."""
    b, p = (F.col(x) if isinstance(x, str) else x for x in (base, peak))
    return F.coalesce(share * p + (1 - share) * b, b)
