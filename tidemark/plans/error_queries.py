"""Queries on forecast errors: a line item's price stands for a forecast, its part's price times quantity for the actual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import PEAK_HOURS
from ..functions.columns import exact_mean, rmse
from ..operators import metrics as m
from ..operators.risk import ranked
from .registry import query, table

E = """e AS (SELECT l_returnflag AS model, l_shipdate::DATE AS day, (l_orderkey % 24)::INT AS hour, (isodow(l_shipdate) - 1)::INT AS day_of_week,
  CASE WHEN l_orderkey % 24 IN (7, 8, 9, 10, 11, 18, 19, 20, 21) THEN 1 ELSE 0 END AS is_peak_hour, CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'normal' END AS risk_level,
  l_extendedprice AS predicted, round(p_retailprice * l_quantity, 2) AS actual, round(p_retailprice * l_quantity, 2) - l_extendedprice AS bias,
  abs(round(p_retailprice * l_quantity, 2) - l_extendedprice) AS abs_error,
  abs(round(p_retailprice * l_quantity, 2) - l_extendedprice) / greatest(abs(round(p_retailprice * l_quantity, 2)), 1e-9) * 100 AS pct_error
FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    hour = (F.col("l_orderkey") % 24).cast("int")
    tracked = lines.select(
        F.col("l_returnflag").alias("model"), F.to_date("l_shipdate").alias("day"), hour.alias("hour"), F.weekday("l_shipdate").alias("day_of_week"), F.when(hour.isin(*PEAK_HOURS), 1).otherwise(0).alias("is_peak_hour"),
        F.when(F.col("l_discount") >= 0.05, "high").otherwise("normal").alias("risk_level"), F.col("l_extendedprice").alias("predicted"), F.round(F.col("p_retailprice") * F.col("l_quantity"), 2).alias("actual"),
    )
    return m.with_errors(tracked, "predicted", "actual")


def _mean(x: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"sum(({x})::{kind})::DOUBLE / count({x})"


def _rmse(x: str, when: str = "true") -> str:
    return f"sqrt(sum(({x} * {x})::DECIMAL(38,4)) FILTER ({when})::DOUBLE / count({x}) FILTER ({when}))"


_FIGURES = f"""count(*) AS n, {_mean("abs_error")} AS mae, round({_rmse("bias")}, 6) AS rmse, round({_mean("pct_error", "DECIMAL(38,12)")}, 6) AS mape,
  round(CASE WHEN count(*) FILTER (is_peak_hour = 1) > 0 THEN {_rmse("bias", "is_peak_hour = 1")} END, 6) AS peak_rmse,
  round(CASE WHEN count(*) FILTER (risk_level = 'high') > 0 THEN {_rmse("bias", "risk_level = 'high'")} END, 6) AS spike_rmse"""
_ROUNDED = ("rmse", "mape", "peak_rmse", "spike_rmse")


def _figures(errors: DataFrame, *keys: str) -> DataFrame:
    return m.error_figures(errors, keys, F.col("is_peak_hour") == 1, F.col("risk_level") == "high")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("error_daily_rollup", f"WITH {E} SELECT model, day, {_FIGURES} FROM e GROUP BY 1, 2")
def error_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_figures(_errors(spark, sf_dir), "model", "day"), *_ROUNDED)


@query("conditional_rmse", f"WITH {E} SELECT model, {_FIGURES} FROM e GROUP BY 1")
def conditional_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_figures(_errors(spark, sf_dir), "model"), *_ROUNDED)


_KEYS = ["model", "hour", "day_of_week", "is_peak_hour", "risk_level"]
_MEMORY = f"""mem AS (SELECT model, hour, day_of_week, is_peak_hour, risk_level, count(*) AS sample_count, {_mean("abs_error")} AS mae, round({_rmse("bias")}, 6) AS rmse,
  {_mean("bias")} AS bias_mean, round(quantile_cont(bias, 0.5), 6) AS bias_median, count(*) FILTER (bias < 0) AS over_count, count(*) FILTER (bias > 0) AS under_count FROM e GROUP BY 1, 2, 3, 4, 5)"""


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(m.error_memory(_errors(spark, sf_dir), _KEYS), "rmse", "bias_median")


@query("error_memory", f"WITH {E}, {_MEMORY} SELECT * FROM mem")
def error_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir)


_LEAST = 10


@query(
    "tiered_lookup_bias",
    f"""WITH {E}, {_MEMORY}, f AS (SELECT o_orderkey, (o_orderkey % 24)::INT AS hour, (isodow(o_orderdate) - 1)::INT AS day_of_week, CASE WHEN o_orderkey % 24 IN (7, 8, 9, 10, 11, 18, 19, 20, 21) THEN 1 ELSE 0 END AS is_peak_hour,
  CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'low' END AS risk_level, o_totalprice / 1000 AS price FROM orders),
g AS (SELECT * FROM mem WHERE sample_count >= {_LEAST}),
t1 AS (SELECT hour, day_of_week, is_peak_hour, risk_level, bias_mean AS v, sample_count AS n FROM (SELECT *, row_number() OVER (PARTITION BY hour, day_of_week, is_peak_hour, risk_level ORDER BY sample_count DESC, bias_mean) AS k FROM g) WHERE k = 1),
t2 AS (SELECT hour, is_peak_hour, bias_mean AS v, sample_count AS n FROM (SELECT *, row_number() OVER (PARTITION BY hour, is_peak_hour ORDER BY sample_count DESC, bias_mean) AS k FROM g) WHERE k = 1),
t3 AS (SELECT hour, bias_mean AS v, sample_count AS n FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY sample_count DESC, bias_mean) AS k FROM g) WHERE k = 1),
r AS (SELECT o_orderkey, price, CASE WHEN t1.n IS NOT NULL THEN 1 WHEN t2.n IS NOT NULL THEN 2 WHEN t3.n IS NOT NULL THEN 3 END::INT AS tier, coalesce(t1.n, t2.n, t3.n) AS samples, coalesce(t1.v, t2.v, t3.v) / 1000 AS bias
FROM f LEFT JOIN t1 ON f.hour = t1.hour AND f.day_of_week = t1.day_of_week AND f.is_peak_hour = t1.is_peak_hour AND f.risk_level = t1.risk_level LEFT JOIN t2 ON f.hour = t2.hour AND f.is_peak_hour = t2.is_peak_hour LEFT JOIN t3 ON f.hour = t3.hour)
SELECT o_orderkey, tier, samples, round(coalesce(greatest(-10, least(10, bias)), 0), 6) AS adjustment, round(greatest(price + coalesce(greatest(-10, least(10, bias)), 0), 0), 6) AS corrected FROM r""",
)
def tiered_lookup_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (F.col("o_orderkey") % 24).cast("int")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", hour.alias("hour"), F.weekday("o_orderdate").alias("day_of_week"), F.when(hour.isin(*PEAK_HOURS), 1).otherwise(0).alias("is_peak_hour"),
        F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("risk_level"), (F.col("o_totalprice") / 1000).alias("price"),
    )
    tiers = [["hour", "day_of_week", "is_peak_hour", "risk_level"], ["hour", "is_peak_hour"], ["hour"]]
    found = m.tiered_lookup(rows, m.error_counts(_errors(spark, sf_dir), _KEYS), tiers, "bias_mean", _LEAST, most_entries=24 * 7 * 2 * 2).withColumn("bias", F.col("found") / 1000)
    out = m.bias_corrected(found, "price", "bias")
    return out.select("o_orderkey", F.col("found_tier").alias("tier"), F.col("found_samples").alias("samples"), F.round("adjustment", 6).alias("adjustment"), F.round("corrected", 6).alias("corrected"))


@query(
    "weighted_bias_summary",
    f"""WITH {E}, {_MEMORY} SELECT model, sum(sample_count)::BIGINT AS sample_count, round(sum(bias_mean::DECIMAL(18,6) * greatest(sample_count, 1)::DECIMAL(18,0))::DOUBLE / sum(greatest(sample_count, 1))::DOUBLE, 6) AS avg_bias,
  round(sum(bias_mean::DECIMAL(28,8)) FILTER (is_peak_hour = 1)::DOUBLE / count(*) FILTER (is_peak_hour = 1), 6) AS peak_avg_bias, round(sum(bias_mean::DECIMAL(28,8)) FILTER (risk_level = 'high')::DOUBLE / count(*) FILTER (risk_level = 'high'), 6) AS spike_avg_bias
FROM mem GROUP BY 1""",
)
def weighted_bias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(m.weighted_bias(m.error_counts(_errors(spark, sf_dir), _KEYS), ["model"]), "avg_bias", "peak_avg_bias", "spike_avg_bias")


_AS_OF = "DATE '2001-08-01'"


@query(
    "drift_decision",
    f"""WITH {E}, w AS (SELECT model, count(*) FILTER (day >= {_AS_OF} - 7) AS n, round({_rmse("bias", f"day >= {_AS_OF} - 7")}, 6) AS recent_rmse, round({_rmse("bias", f"day >= {_AS_OF} - 30")}, 6) AS baseline_rmse FROM e WHERE day <= {_AS_OF} AND day >= {_AS_OF} - 30 GROUP BY 1)
SELECT *, CASE WHEN n < 24 THEN 'insufficient_data' WHEN baseline_rmse > 0 AND recent_rmse > 1.2 * baseline_rmse THEN 'degraded' WHEN recent_rmse > 80 THEN 'high_error' ELSE 'healthy' END AS decision FROM w""",
)
def drift_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2001-08-01").cast("date")
    recent, window = F.col("day") >= F.date_sub(as_of, 7), _errors(spark, sf_dir).where((F.col("day") <= as_of) & (F.col("day") >= F.date_sub(as_of, 30)))
    out = window.groupBy("model").agg(F.count(F.when(recent, 1)).alias("n"), F.round(rmse(F.when(recent, F.col("bias"))), 6).alias("recent_rmse"), F.round(rmse("bias"), 6).alias("baseline_rmse"))
    return out.withColumn("decision", m.drift(F.col("n"), F.col("recent_rmse"), F.col("baseline_rmse")))


@query(
    "retrain_reasons",
    f"""WITH {E}, d AS (SELECT model, day, {_FIGURES} FROM e WHERE day <= {_AS_OF} GROUP BY 1, 2),
k AS (SELECT *, day >= {_AS_OF} - 7 AS week, day >= {_AS_OF} - 30 AS month, CASE WHEN model = 'N' THEN NULL ELSE DATE '2001-07-10' END AS trained, CASE WHEN model = 'A' THEN 100.0::DOUBLE END AS spike_base FROM d),
o AS (SELECT model, count(*) AS days, bool_and(coalesce(peak_rmse, 0) > 35) AS high FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) AS r FROM k WHERE week) WHERE r <= 3 GROUP BY 1),
g AS (SELECT model, coalesce(sum(n) FILTER (week), 0)::BIGINT AS n_7d, sum(rmse::DECIMAL(28,8)) FILTER (week)::DOUBLE / nullif(count(rmse) FILTER (week), 0) AS rmse_7d, sum(rmse::DECIMAL(28,8)) FILTER (month)::DOUBLE / nullif(count(rmse) FILTER (month), 0) AS rmse_30d,
  sum(spike_rmse::DECIMAL(28,8)) FILTER (week)::DOUBLE / nullif(count(spike_rmse) FILTER (week), 0) AS spike, max(spike_base) AS base, max(trained) AS trained FROM k GROUP BY 1),
x AS (SELECT g.model, n_7d, round(rmse_7d, 6) AS rmse_7d, round(rmse_30d, 6) AS rmse_30d, concat_ws(';', CASE WHEN rmse_7d > 1.2 * rmse_30d THEN 'rmse' END, CASE WHEN o.days >= 3 AND o.high THEN 'peak' END, CASE WHEN spike > 1.15 * base THEN 'spike' END,
  CASE WHEN trained IS NULL THEN 'untrained' WHEN {_AS_OF} - trained > 14 THEN 'age' END) AS reasons FROM g LEFT JOIN o USING (model))
SELECT *, reasons <> '' AS should_retrain FROM x""",
)
def retrain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2001-08-01").cast("date")
    daily = _round(_figures(_errors(spark, sf_dir).where(F.col("day") <= as_of), "model", "day"), *_ROUNDED)
    trained = F.when(F.col("model") != "N", F.lit("2001-07-10").cast("date"))
    return _round(m.retrain_reasons(daily, "model", as_of, F.when(F.col("model") == "A", F.lit(100.0)), trained), "rmse_7d", "rmse_30d")


@query(
    "promotion_decision",
    f"""WITH {E}, f AS (SELECT model, {_FIGURES} FROM e GROUP BY 1)
SELECT c.model AS candidate, a.model AS active, c.rmse AS candidate_rmse, a.rmse AS active_rmse, coalesce(c.rmse <= a.rmse * 0.97, false) AND coalesce(c.peak_rmse <= a.peak_rmse * 1.0, false) AND coalesce(c.spike_rmse <= a.spike_rmse * 1.05, false) AS promote
FROM f c JOIN f a ON c.model <> a.model AND a.model = 'N'""",
)
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _round(_figures(_errors(spark, sf_dir), "model"), *_ROUNDED)
    active = f.where("model = 'N'").select(F.col("model").alias("active"), *[F.col(c).alias(f"a_{c}") for c in ("rmse", "peak_rmse", "spike_rmse")])
    both = f.where("model <> 'N'").join(F.broadcast(active), F.lit(True))
    wins = m.promotes(tuple(F.col(c) for c in ("rmse", "peak_rmse", "spike_rmse")), tuple(F.col(f"a_{c}") for c in ("rmse", "peak_rmse", "spike_rmse")))
    return both.select(F.col("model").alias("candidate"), "active", F.col("rmse").alias("candidate_rmse"), F.col("a_rmse").alias("active_rmse"), wins.alias("promote"))


@query(
    "regression_metrics",
    f"""WITH {E}, x AS (SELECT model, predicted AS p, actual AS a FROM e), s AS (SELECT model, count(*) AS n, sum(abs(a - p)::DECIMAL(18,2))::DOUBLE / count(*) AS mae, sum(((a - p) * (a - p))::DECIMAL(38,4))::DOUBLE AS square,
  sum((abs(a - p) / abs(CASE WHEN a = 0 THEN 1e-6::DOUBLE ELSE a END) * 100)::DECIMAL(38,12))::DOUBLE / count(*) AS mape, sum((a * a)::DECIMAL(38,4))::DOUBLE - pow(sum(a::DECIMAL(18,2))::DOUBLE, 2) / count(*) AS total FROM x GROUP BY 1)
SELECT model, n, mae, round(sqrt(square / n), 6) AS rmse, round(mape, 6) AS mape, round(CASE WHEN total > 0 THEN 1 - square / total END, 6) AS r2 FROM s""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(m.regression_figures(_errors(spark, sf_dir), ["model"], "predicted", "actual"), "rmse", "mape", "r2")


@query(
    "trailing_window_rmse",
    f"""WITH {E} SELECT model, count(*) AS n, round({_rmse("bias")}, 6) AS rmse, max(abs_error) AS worst FROM e WHERE day > {_AS_OF} - 90 AND day <= {_AS_OF} GROUP BY 1""",
)
def trailing_window_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2001-08-01").cast("date")
    recent = _errors(spark, sf_dir).where((F.col("day") > F.date_sub(as_of, 90)) & (F.col("day") <= as_of))
    return recent.groupBy("model").agg(F.count("*").alias("n"), F.round(rmse("bias"), 6).alias("rmse"), F.max("abs_error").alias("worst"))


@query(
    "strategy_rank",
    f"""WITH {E}, s AS (SELECT day_of_week AS strategy, {_FIGURES} FROM e GROUP BY 1),
r AS (SELECT strategy, rmse, peak_rmse, spike_rmse, n, 1 / (1 + coalesce(rmse, 0) + 0.25 * coalesce(peak_rmse, 0) + 0.25 * coalesce(spike_rmse, 0)) AS score FROM s)
SELECT strategy, rmse, peak_rmse, spike_rmse, n, round(score, 12) AS score, (row_number() OVER (ORDER BY rmse, peak_rmse NULLS LAST, spike_rmse NULLS LAST, n DESC, strategy))::INT AS place FROM r""",
)
def strategy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _round(_figures(_errors(spark, sf_dir), "day_of_week"), *_ROUNDED)
    s = s.select(F.col("day_of_week").alias("strategy"), "rmse", "peak_rmse", "spike_rmse", "n", F.round(m.strategy_score(F.col("rmse"), F.col("peak_rmse"), F.col("spike_rmse")), 12).alias("score"))
    order = [F.asc("rmse"), F.asc_nulls_last("peak_rmse"), F.asc_nulls_last("spike_rmse"), F.desc("n"), F.asc("strategy")]
    # Seven rows, one for each weekday.
    return ranked(s.withColumn("_one", F.lit(1)), ["_one"], 1000, *order).drop("_one")


@query(
    "preferred_else_best",
    f"""WITH {E}, f AS (SELECT risk_level, hour, {_FIGURES} FROM e GROUP BY 1, 2) SELECT risk_level, hour, rmse, n FROM (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY regexp_matches(hour::VARCHAR, '^1[27]$') AND n >= 50 DESC, rmse, hour) AS k FROM f) WHERE k = 1""",
)
def preferred_else_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _round(_figures(_errors(spark, sf_dir), "risk_level", "hour"), *_ROUNDED)
    return m.preferred_else_best(f, ["risk_level"], F.col("hour").cast("string").rlike("^1[27]$") & (F.col("n") >= 50), F.asc("rmse"), F.asc("hour")).select("risk_level", "hour", "rmse", "n")


@query(
    "fold_summary",
    f"""WITH {E}, f AS (SELECT model, year(day)::INT AS fold, round({_rmse("bias")}, 6) AS rmse FROM e GROUP BY 1, 2)
SELECT model, count(*) AS n_folds, round(sum(rmse::DECIMAL(28,8))::DOUBLE / count(rmse), 6) AS mean_error, max(rmse) AS worst_error, arg_min(fold, {{'e': -rmse, 'f': fold}}) AS worst_fold FROM f WHERE rmse IS NOT NULL GROUP BY 1""",
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _errors(spark, sf_dir).groupBy("model", F.year("day").alias("fold")).agg(F.round(rmse("bias"), 6).alias("rmse"))
    return _round(m.fold_summary(folds, ["model"], "fold", "rmse"), "mean_error")


@query(
    "best_worst_hours",
    f"""WITH {E}, h AS (SELECT model, hour, {_mean("abs_error")} AS mae FROM e GROUP BY 1, 2)
SELECT model, hour, mae, 'best' AS side, place FROM (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY mae, hour))::INT AS place FROM h) WHERE place <= 3
UNION ALL SELECT model, hour, mae, 'worst', place FROM (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY mae DESC, hour))::INT AS place FROM h) WHERE place <= 3""",
)
def best_worst_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _errors(spark, sf_dir).groupBy("model", "hour").agg(exact_mean("abs_error").alias("mae"))
    best = ranked(h, ["model"], 3, F.asc("mae"), F.asc("hour")).withColumn("side", F.lit("best"))
    return best.unionByName(ranked(h, ["model"], 3, F.desc("mae"), F.asc("hour")).withColumn("side", F.lit("worst")))
