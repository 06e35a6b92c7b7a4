"""Queries on the hourly series of events, one series for each event type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import cyclic, is_us_holiday, with_calendar
from ..functions.columns import clip, exact_mean, percent_change
from ..functions.predicates import day_or_last
from ..operators.keys import priority_union, union_keep
from ..operators.metrics import residual_intervals, time_split
from ..operators.numbering import haloed
from ..operators.quantiles import with_quantiles, with_quantiles_of
from ..operators.risk import advice, confidence, data_level, explained, overall, ranked, score, storage_windows, tertile
from ..operators.series import complete_until, day_ahead_vintage, gap_counts, hourly, resume_from, with_lags, with_rolling, with_same_hour_before, with_step
from .registry import query, table

H = """h AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS price, count(*) AS load
      FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"""
# A spike probability for each hour, by rule: the share of its events that are worth 100 or more.
P = """p AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS price, count(*) AS load,
        count(*) FILTER (value >= 100)::DOUBLE / count(*) AS probability, CASE WHEN hour(date_trunc('hour', ts)) IN (7, 8, 9, 10, 11, 18, 19, 20, 21) THEN 1 ELSE 0 END AS is_peak_hour
      FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value")


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts is not null")
    hours = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts")).agg(
        exact_mean("value").alias("price"), F.count("*").alias("load"), (F.count(F.when(F.col("value") >= 100, 1)) / F.count("*")).alias("probability")
    )
    return with_calendar(hours, "hour_ts").select("event_type", "hour_ts", "price", "load", "probability", "is_peak_hour")


def _rolled(c: str, n: int) -> str:
    w = f"(PARTITION BY event_type ORDER BY hour_ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    exact = f"round((sum({c}::DECIMAL(28,12)) OVER {w})::DOUBLE / {n}, 8)"
    parts = {"mean": exact, "std": f"round(stddev_samp({c}) OVER {w}, 8)", "min": f"min({c}) OVER {w}", "max": f"max({c}) OVER {w}"}
    return ", ".join(f"CASE WHEN count({c}) OVER {w} = {n} THEN {x} END AS {c}_roll_{name}_{n}" for name, x in parts.items())


_LAGS = {"price": [1, 2, 3, 24, 48, 72, 168], "load": [1, 24, 48, 168]}


@query(
    "hourly_features",
    f"""WITH {H}
SELECT event_type, hour_ts, price, load, hour(hour_ts)::INT AS hour, (isodow(hour_ts) - 1)::INT AS day_of_week, month(hour_ts)::INT AS month,
  day(hour_ts)::INT AS day, year(hour_ts)::INT AS year, CASE WHEN isodow(hour_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(hour_ts) IN (7, 8, 9, 10, 11, 18, 19, 20, 21) THEN 1 ELSE 0 END AS is_peak_hour,
  CASE WHEN month(hour_ts) IN (12, 1, 2) THEN 'winter' WHEN month(hour_ts) <= 5 THEN 'spring' WHEN month(hour_ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  round(sin(2 * pi() * hour(hour_ts) / 24), 8) AS hour_sin, round(cos(2 * pi() * hour(hour_ts) / 24), 8) AS hour_cos,
  round(sin(2 * pi() * (isodow(hour_ts) - 1) / 7), 8) AS dow_sin, round(cos(2 * pi() * (isodow(hour_ts) - 1) / 7), 8) AS dow_cos,
  round(sin(2 * pi() * month(hour_ts) / 12), 8) AS month_sin, round(cos(2 * pi() * month(hour_ts) / 12), 8) AS month_cos,
  {", ".join(f"lag({c}, {k}) OVER (PARTITION BY event_type ORDER BY hour_ts) AS {c}_lag_{k}" for c, ks in _LAGS.items() for k in ks)},
  {_rolled("price", 24)}, {_rolled("price", 48)}, {_rolled("price", 168)} FROM h""",
)
def hourly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_calendar(_hours(spark, sf_dir), "hour_ts")
    for name, column, period in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12)):
        sine, cosine = cyclic(F.col(column), period)
        out = out.withColumns({f"{name}_sin": F.round(sine, 8), f"{name}_cos": F.round(cosine, 8)})
    out = with_rolling(with_lags(out, "event_type", "hour_ts", _LAGS), "event_type", "hour_ts", ["price"], [24, 48, 168])
    return out.withColumns({c: F.round(c, 8) for c in out.columns if "_roll_mean_" in c or "_roll_std_" in c})


@query(
    "hourly_calendar_profile",
    """SELECT event_type, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS mean_value, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""",
)
def hourly_calendar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts is not null")
    return events.groupBy("event_type", F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week")).agg(exact_mean("value").alias("mean_value"), F.count("*").alias("n"))


@query(
    "dow_hour_pivot",
    "SELECT (isodow(ts) - 1)::INT AS day_of_week, "
    + ", ".join(f"sum(value::DECIMAL(18,2)) FILTER (hour(ts) = {h})::DOUBLE / nullif(count(value) FILTER (hour(ts) = {h}), 0) AS h{h}" for h in range(24))
    + " FROM events WHERE ts IS NOT NULL GROUP BY 1",
)
def dow_hour_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts is not null").select(F.weekday("ts").alias("day_of_week"), F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("hour"), "value")
    return events.groupBy("day_of_week").pivot("hour", [f"h{h}" for h in range(24)]).agg(exact_mean("value"))


@query(
    "daily_peak_valley",
    f"""WITH {H} SELECT event_type, hour_ts::DATE AS day, max(price) AS peak, min(price) AS valley, max(price) - min(price) AS spread FROM h GROUP BY 1, 2""",
)
def daily_peak_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _hours(spark, sf_dir).groupBy("event_type", F.to_date("hour_ts").alias("day")).agg(F.max("price").alias("peak"), F.min("price").alias("valley"))
    return daily.withColumn("spread", F.col("peak") - F.col("valley"))


@query(
    "asof_vintage",
    """WITH f AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 12 HOUR + to_days((event_id % 3)::INT) AS target, ts, event_id, value FROM events),
u AS (SELECT *, ts::DATE = target::DATE - 1 AS before FROM f WHERE ts::DATE = target::DATE - 1 OR ts < target)
SELECT user_id, target, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY before DESC, ts DESC, event_id DESC) AS n FROM u) WHERE n = 1""",
)
def asof_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.expr("cast(date_trunc('day', ts) as timestamp_ntz) + INTERVAL 12 HOURS + make_dt_interval(cast(event_id % 3 as int))")
    forecasts = table(spark, sf_dir, "events").select("user_id", target.alias("target"), "ts", "event_id", "value")
    return day_ahead_vintage(forecasts, ["user_id"], "target", "ts", "event_id")


@query(
    "lag_lookup_compare",
    f"""WITH {H}
SELECT a.event_type, a.hour_ts, a.price, b.price AS price_1d, c.price AS price_7d,
  round(CASE WHEN b.price <> 0 THEN (a.price - b.price) / b.price * 100 END, 6) AS change_1d, round(CASE WHEN c.price <> 0 THEN (a.price - c.price) / c.price * 100 END, 6) AS change_7d
FROM h a LEFT JOIN h b ON a.event_type = b.event_type AND b.hour_ts = a.hour_ts - INTERVAL 1 DAY LEFT JOIN h c ON a.event_type = c.event_type AND c.hour_ts = a.hour_ts - INTERVAL 7 DAY""",
)
def lag_lookup_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_same_hour_before(_hours(spark, sf_dir).drop("load"), "event_type", "hour_ts", "price", [1, 7])
    return out.withColumns({f"change_{d}d": F.round(percent_change("price", f"price_{d}d"), 6) for d in (1, 7)})


@query(
    "day_comparison",
    f"""WITH {H}, d AS (SELECT event_type, hour_ts::DATE AS day, sum(price::DECIMAL(28,12))::DOUBLE / count(*) AS mean_price,
  sum(price::DECIMAL(28,12)) FILTER (hour(hour_ts) BETWEEN 6 AND 9 OR hour(hour_ts) BETWEEN 18 AND 21)::DOUBLE / nullif(count(*) FILTER (hour(hour_ts) BETWEEN 6 AND 9 OR hour(hour_ts) BETWEEN 18 AND 21), 0) AS peak_price
  FROM h GROUP BY 1, 2)
SELECT a.event_type, a.day, a.mean_price, a.peak_price, round(CASE WHEN b.mean_price <> 0 THEN (a.mean_price - b.mean_price) / b.mean_price * 100 END, 6) AS change_1d,
  round(CASE WHEN c.mean_price <> 0 THEN (a.mean_price - c.mean_price) / c.mean_price * 100 END, 6) AS change_7d,
  round(CASE WHEN b.peak_price <> 0 THEN (a.peak_price - b.peak_price) / b.peak_price * 100 END, 6) AS peak_change_1d
FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.day = a.day - 1 LEFT JOIN d c ON a.event_type = c.event_type AND c.day = a.day - 7""",
)
def day_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = F.hour("hour_ts").between(6, 9) | F.hour("hour_ts").between(18, 21)
    d = _hours(spark, sf_dir).groupBy("event_type", F.to_date("hour_ts").alias("day"))
    d = d.agg(exact_mean("price", "decimal(28,12)").alias("mean_price"), exact_mean(F.when(peak, F.col("price")), "decimal(28,12)").alias("peak_price"))
    b, c = (d.select(F.col("event_type").alias(f"t{n}"), F.date_add("day", n).alias(f"day{n}"), F.col("mean_price").alias(f"mean{n}"), F.col("peak_price").alias(f"peak{n}")) for n in (1, 7))
    out = d.join(b, F.expr("event_type = t1 and day = day1"), "left").join(c, F.expr("event_type = t7 and day = day7"), "left")
    changes = {"change_1d": ("mean_price", "mean1"), "change_7d": ("mean_price", "mean7"), "peak_change_1d": ("peak_price", "peak1")}
    return out.select("event_type", "day", "mean_price", "peak_price", *[F.round(percent_change(x, y), 6).alias(n) for n, (x, y) in changes.items()])


@query(
    "completeness_cut",
    """SELECT event_id, ts FROM events WHERE ts <= (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase' AND value >= 10)) FROM events)""",
)
def completeness_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    sources = {"clicks": kind == "click", "views": kind == "view", "purchases": (kind == "purchase") & (F.col("value") >= 10)}
    return complete_until(table(spark, sf_dir, "events"), "ts", sources).select("event_id", "ts")


@query("incremental_start", "SELECT greatest(max(ts) - INTERVAL 3 DAY, TIMESTAMP '2024-01-01') AS start_ts FROM events")
def incremental_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume_from(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-01").cast("timestamp_ntz"))


@query(
    "keep_first_union",
    """SELECT event_id, ts, value, 'old' AS origin FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, ts, value + 1, 'new' FROM events WHERE event_id % 3 = 0""",
)
def keep_first_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    old = events.where("event_id % 3 <> 0").withColumn("origin", F.lit("old"))
    new = events.where("event_id % 2 = 0 or event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "origin": F.lit("new")})
    return union_keep(old, new, ["event_id"])


@query(
    "time_gap_histogram",
    f"""WITH {H}, g AS (SELECT event_type, date_diff('second', lag(hour_ts) OVER (PARTITION BY event_type ORDER BY hour_ts), hour_ts) AS gap_seconds FROM h),
c AS (SELECT event_type, gap_seconds, count(*) AS n FROM g WHERE gap_seconds IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY n DESC, gap_seconds))::INT AS place FROM c) WHERE place <= 3""",
)
def time_gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_counts(_hours(spark, sf_dir), "event_type", "hour_ts")


_Q = """q AS (SELECT event_type, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75, quantile_cont(price, 0.9) AS p90, quantile_cont(load::DOUBLE, 0.75) AS load75 FROM p GROUP BY 1),
x AS (SELECT * FROM p JOIN q USING (event_type))"""


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {"price": {"p25": 0.25, "p75": 0.75, "p90": 0.9}, "load": {"load75": 0.75}}
    return with_quantiles_of(_risky(spark, sf_dir), ["event_type"], points)


@query(
    "risk_level_bucket",
    f"""WITH {P}, {_Q} SELECT event_type, hour_ts, CASE WHEN probability >= 0.5 THEN 'high' WHEN probability >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN price >= p90 OR probability >= 0.4 THEN 'high' WHEN price >= p75 OR probability >= 0.15 THEN 'medium' ELSE 'low' END AS data_level FROM x""",
)
def risk_level_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import level

    return _thresholds(spark, sf_dir).select("event_type", "hour_ts", level("probability").alias("risk_level"), data_level(F.col("price"), F.col("probability"), F.col("p90"), F.col("p75")).alias("data_level"))


@query(
    "tertile_bins",
    """WITH n AS (SELECT c_mktsegment, count(c_acctbal) AS n, quantile_cont(c_acctbal, 0.33) AS a, quantile_cont(c_acctbal, 0.66) AS b FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN n < 10 OR c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal <= a THEN 'low' WHEN c_acctbal <= b THEN 'mid' ELSE 'high' END AS bin FROM customer JOIN n USING (c_mktsegment)""",
)
def tertile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = with_quantiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", {"a": 0.33, "b": 0.66})
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("n"))
    return customers.join(n, "c_mktsegment").select("c_custkey", tertile(F.col("c_acctbal"), F.col("n"), F.col("a"), F.col("b")).alias("bin"))


@query(
    "top_bottom_k",
    f"""WITH {P} SELECT event_type, hour_ts, price, 'top' AS side, place FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY price DESC, hour_ts))::INT AS place FROM p) WHERE place <= 5
UNION ALL SELECT event_type, hour_ts, price, 'bottom', place FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY price, hour_ts))::INT AS place FROM p) WHERE place <= 5""",
)
def top_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _hours(spark, sf_dir).select("event_type", "hour_ts", "price")
    top = ranked(hours, ["event_type"], 5, F.desc("price"), F.col("hour_ts")).withColumn("side", F.lit("top"))
    return top.unionByName(ranked(hours, ["event_type"], 5, F.asc("price"), F.col("hour_ts")).withColumn("side", F.lit("bottom")))


@query(
    "threshold_topk_windows",
    f"""WITH {P}, q AS (SELECT event_type, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75 FROM p GROUP BY 1), x AS (SELECT event_type, hour_ts, price, p25, p75 FROM p JOIN q USING (event_type))
SELECT event_type, hour_ts, price, 'charge' AS action, place FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY price, hour_ts))::INT AS place FROM x WHERE price <= p25) WHERE place <= 5
UNION ALL SELECT event_type, hour_ts, price, 'discharge', place FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY price DESC, hour_ts))::INT AS place FROM x WHERE price >= p75) WHERE place <= 5""",
)
def threshold_topk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_windows(_hours(spark, sf_dir), ["event_type"], "price", "hour_ts").select("event_type", "hour_ts", "price", "action", "place")


_SCORE = """round(CASE WHEN probability >= 0.5 THEN 3.0::DOUBLE WHEN probability >= 0.2 THEN 1.0 ELSE 0.0 END + CASE WHEN price >= p75 THEN 1.2::DOUBLE ELSE 0.0 END
  + CASE WHEN probability >= 0.5 THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN is_peak_hour = 1 THEN 0.5::DOUBLE ELSE 0.0 END, 2)"""


@query(
    "risk_score_rank",
    f"""WITH {P}, {_Q}, s AS (SELECT event_type, hour_ts, price, {_SCORE} AS score FROM x)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY score DESC, price DESC, hour_ts))::INT AS place FROM s) WHERE place <= 6""",
)
def risk_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = score(F.col("price"), F.col("p75"), F.col("probability"), F.col("is_peak_hour"))
    scored = _thresholds(spark, sf_dir).select("event_type", "hour_ts", "price", points.alias("score"))
    return ranked(scored, ["event_type"], 6, F.desc("score"), F.desc("price"), F.col("hour_ts"))


@query(
    "advice_explode",
    f"""WITH {P}, {_Q}
SELECT event_type, hour_ts, 'high price' AS advice_type, CASE WHEN probability >= 0.5 THEN 'high' ELSE 'medium' END AS risk_level, true AS must_watch FROM x WHERE price >= p75
UNION ALL SELECT event_type, hour_ts, 'low price window', 'low', false FROM x WHERE price <= p25
UNION ALL SELECT event_type, hour_ts, 'manual review', 'high', true FROM x WHERE probability >= 0.5
UNION ALL SELECT event_type, hour_ts, 'peak load', 'medium', true FROM x WHERE is_peak_hour = 1 AND load >= load75""",
)
def advice_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advice(_thresholds(spark, sf_dir), *[F.col(c) for c in ("price", "p25", "p75", "probability", "is_peak_hour", "load", "load75")])
    return out.select("event_type", "hour_ts", "advice_type", "risk_level", "must_watch")


@query(
    "anomaly_reasons",
    f"""WITH {P}, {_Q}, r AS (SELECT *, concat_ws('; ', CASE WHEN price >= p75 THEN 'price' END, CASE WHEN probability >= 0.5 THEN 'spike' END, CASE WHEN is_peak_hour = 1 THEN 'peak' END, CASE WHEN load >= load75 THEN 'load' END) AS explanation FROM x)
SELECT event_type, hour_ts, explanation, CASE WHEN probability >= 0.5 THEN 'high' WHEN price >= p75 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN probability >= 0.5 THEN 'price, spike or peak load' ELSE 'high price' END AS anomaly_type FROM r WHERE explanation <> ''""",
)
def anomaly_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explained(_thresholds(spark, sf_dir), *[F.col(c) for c in ("price", "p75", "probability", "is_peak_hour", "load", "load75")])
    return out.select("event_type", "hour_ts", "explanation", "risk_level", "anomaly_type")


_STEP = """d AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY event_type ORDER BY hour_ts)) AS abs_step FROM p)"""


@query(
    "priority_union_focus",
    f"""WITH {P}, {_STEP},
l AS (SELECT event_type, hour_ts, 0 AS list, row_number() OVER (PARTITION BY event_type ORDER BY price DESC, hour_ts) AS place FROM d
 UNION ALL SELECT event_type, hour_ts, 1, row_number() OVER (PARTITION BY event_type ORDER BY probability DESC, hour_ts) FROM d WHERE probability >= 0.15
 UNION ALL SELECT event_type, hour_ts, 2, row_number() OVER (PARTITION BY event_type ORDER BY price DESC, hour_ts) FROM d WHERE is_peak_hour = 1 AND probability >= 0.2
 UNION ALL SELECT event_type, hour_ts, 3, row_number() OVER (PARTITION BY event_type ORDER BY abs_step DESC NULLS LAST, hour_ts) FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, hour_ts ORDER BY list, place) AS k FROM l WHERE place <= 2)
SELECT event_type, hour_ts, focus_place FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY list, place))::INT AS focus_place FROM o WHERE k = 1) WHERE focus_place <= 6""",
)
def priority_union_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_step(_risky(spark, sf_dir), "event_type", "hour_ts", "price")
    key, tie = ["event_type"], F.col("hour_ts")
    high = ranked(d, key, 2, F.desc("price"), tie)
    spike = ranked(d.where("probability >= 0.15"), key, 2, F.desc("probability"), tie)
    peak = ranked(d.where("is_peak_hour = 1 and probability >= 0.2"), key, 2, F.desc("price"), tie)
    moved = ranked(d, key, 2, F.desc_nulls_last("abs_step"), tie)
    return priority_union([high, spike, peak, moved], ["hour_ts"], 6, ["event_type"]).select("event_type", "hour_ts", "focus_place")


@query(
    "overall_risk_grade",
    f"""WITH {P}, {_Q}, g AS (SELECT event_type, count(*) FILTER (probability >= 0.5) AS n_high, coalesce(max(probability), 0) AS most_probability, bool_or(price >= p75) AS dear FROM x GROUP BY 1)
SELECT event_type, n_high, most_probability, CASE WHEN n_high >= 3 OR most_probability >= 0.8 THEN 'high' WHEN n_high >= 1 THEN 'medium-high' WHEN dear THEN 'medium' ELSE 'low' END AS overall FROM g""",
)
def overall_risk_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall(_thresholds(spark, sf_dir), ["event_type"], "probability", "price", "p75")


@query(
    "hour_detail",
    f"""WITH {P}, {_Q}, d AS (SELECT *, sum(price::DECIMAL(28,12)) OVER (PARTITION BY event_type)::DOUBLE / count(price) OVER (PARTITION BY event_type) AS mean_price,
  (rank() OVER (PARTITION BY event_type ORDER BY price DESC))::INT AS price_rank FROM x)
SELECT event_type, hour_ts, price, mean_price, round(p25, 6) AS p25, round(p75, 6) AS p75, price_rank,
  concat_ws('; ', CASE WHEN price >= p75 THEN 'price' END, CASE WHEN probability >= 0.5 THEN 'spike' END, CASE WHEN is_peak_hour = 1 THEN 'peak' END, CASE WHEN load >= load75 THEN 'load' END) AS reasons
FROM d WHERE hour(hour_ts) = 18""",
)
def hour_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.risk import reasons

    d = _thresholds(spark, sf_dir)
    mean = d.groupBy("event_type").agg(exact_mean("price", "decimal(28,12)").alias("mean_price"))
    d = d.withColumn("price_rank", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("price")))).join(mean, "event_type")
    why = F.array_join(reasons(*[F.col(c) for c in ("price", "p75", "probability", "is_peak_hour", "load", "load75")]), "; ")
    return d.where(F.hour("hour_ts") == 18).select("event_type", "hour_ts", "price", "mean_price", F.round("p25", 6).alias("p25"), F.round("p75", 6).alias("p75"), "price_rank", why.alias("reasons"))


@query(
    "series_summary_argmax",
    f"""WITH {P}, {_Q}, r AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS high FROM x)
SELECT event_type, count(*) AS n, min(hour_ts) AS first_ts, max(hour_ts) AS last_ts, min(price) AS least, max(price) AS most, sum(price::DECIMAL(28,12))::DOUBLE / count(price) AS mean, max(price) - min(price) AS spread,
  arg_max(hour_ts, {{'p': price, 't': -epoch_us(hour_ts)}}) AS most_ts, arg_min(hour_ts, {{'p': price, 't': epoch_us(hour_ts)}}) AS least_ts, sum(high)::BIGINT AS n_high,
  round(greatest(0.05, least(0.95, 1 - (max(price) - min(price)) / 100)), 6) AS confidence FROM r GROUP BY 1""",
)
def series_summary_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = _thresholds(spark, sf_dir), F.unix_micros(F.col("hour_ts").cast("timestamp"))
    return d.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("hour_ts").alias("first_ts"), F.max("hour_ts").alias("last_ts"), F.min("price").alias("least"), F.max("price").alias("most"),
        exact_mean("price", "decimal(28,12)").alias("mean"), (F.max("price") - F.min("price")).alias("spread"), F.max_by("hour_ts", F.struct("price", -t)).alias("most_ts"),
        F.min_by("hour_ts", F.struct("price", t)).alias("least_ts"), F.count(F.when(F.col("probability") >= 0.5, 1)).alias("n_high"), F.round(confidence(F.max("price") - F.min("price")), 6).alias("confidence"),
    )


_SPLIT = "CASE WHEN hour_ts >= max(hour_ts) OVER (PARTITION BY event_type) - INTERVAL 7 DAY THEN 'test' ELSE 'train' END AS part"


@query(
    "residual_intervals",
    f"""WITH {H}, b AS (SELECT event_type, hour_ts, price, lag(price, 24) OVER (PARTITION BY event_type ORDER BY hour_ts) AS predicted, {_SPLIT} FROM h),
r AS (SELECT event_type, hour(hour_ts) AS hour, price - predicted AS residual FROM b WHERE part = 'train' AND predicted IS NOT NULL AND hour(hour_ts) <> 13),
k AS (SELECT event_type, hour, quantile_cont(residual, 0.1) AS lo, quantile_cont(residual, 0.9) AS hi FROM r GROUP BY 1, 2), a AS (SELECT quantile_cont(residual, 0.1) AS lo, quantile_cont(residual, 0.9) AS hi FROM r)
SELECT b.event_type, hour_ts, predicted, round(predicted + coalesce(k.lo, a.lo), 6) AS lower, round(predicted + coalesce(k.hi, a.hi), 6) AS upper
FROM b CROSS JOIN a LEFT JOIN k ON b.event_type = k.event_type AND hour(hour_ts) = k.hour WHERE part = 'test' AND predicted IS NOT NULL""",
)
def residual_intervals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = time_split(with_lags(_hours(spark, sf_dir), "event_type", "hour_ts", {"price": [24]}), "event_type", "hour_ts", 7)
    hours = hours.where("price_lag_24 is not null").withColumnRenamed("price_lag_24", "predicted").withColumn("hour", F.hour("hour_ts"))
    # Hour 13 is left out of the past so that the overall residuals stand in for it.
    past = hours.where("part = 'train' and hour <> 13").select("event_type", "hour", (F.col("price") - F.col("predicted")).alias("residual"))
    out = residual_intervals(hours.where("part = 'test'"), past, ["event_type", "hour"], "predicted")
    return out.select("event_type", "hour_ts", "predicted", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(
    "train_test_split_lag_baseline",
    f"""WITH {H}, b AS (SELECT event_type, hour_ts, price, lag(price, 24) OVER (PARTITION BY event_type ORDER BY hour_ts) AS y, lag(price, 168) OVER (PARTITION BY event_type ORDER BY hour_ts) AS w, {_SPLIT} FROM h)
SELECT event_type, part, count(*) AS n, round(sum(abs(price - y)::DECIMAL(28,12))::DOUBLE / count(y), 8) AS mae_1d, round(sum(abs(price - w)::DECIMAL(28,12))::DOUBLE / count(w), 8) AS mae_7d FROM b GROUP BY 1, 2""",
)
def train_test_split_lag_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = time_split(with_lags(_hours(spark, sf_dir), "event_type", "hour_ts", {"price": [24, 168]}), "event_type", "hour_ts", 7)
    figures = {f"mae_{n}d": F.round(exact_mean(F.abs(F.col("price") - F.col(f"price_lag_{24 * n}")), "decimal(28,12)"), 8) for n in (1, 7)}
    return hours.groupBy("event_type", "part").agg(F.count("*").alias("n"), *[x.alias(n) for n, x in figures.items()])


@query(
    "date_range_summary",
    f"""WITH {H} SELECT event_type, hour_ts::DATE AS day, count(*) AS n_hours, min(price) AS least, max(price) AS most, sum(price::DECIMAL(28,12))::DOUBLE / count(price) AS mean, sum(load)::BIGINT AS total_load
FROM h WHERE hour_ts >= TIMESTAMP '2024-01-05' AND hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
)
def date_range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The range is put to the scan, on whole hours, so files and row groups outside it are skipped.
    events = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-19' + interval 1 day")
    hours = hourly(events, "event_type", "ts", "value")
    return hours.groupBy("event_type", F.to_date("hour_ts").alias("day")).agg(F.count("*").alias("n_hours"), F.min("price").alias("least"), F.max("price").alias("most"), exact_mean("price", "decimal(28,12)").alias("mean"), F.sum("load").alias("total_load"))


@query(
    "time_range_filters",
    """SELECT event_id, ts, ts::DATE = DATE '2024-01-10' AS on_day FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28 12:00:00' AND ts < DATE '2024-01-27' + INTERVAL 1 DAY""",
)
def time_range_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").where((ts >= at("2024-01-02")) & ts.between(at("2024-01-03"), at("2024-01-28 12:00:00")) & (ts < at("2024-01-28")))
    return events.select("event_id", "ts", (F.to_date("ts") == F.lit("2024-01-10").cast("date")).alias("on_day"))


@query(
    "season_holiday_recode",
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, month(o_orderdate) AS m, day(o_orderdate) AS n, isodow(o_orderdate) - 1 AS w FROM orders),
f AS (SELECT * FROM (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) AS t(fm, fd, since))
SELECT o_orderkey, CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m <= 5 THEN 'spring' WHEN m <= 8 THEN 'summer' ELSE 'autumn' END AS season, w >= 5 AS is_weekend,
  (m IN (1, 2) AND w = 0 AND n BETWEEN 15 AND 21) OR (m = 5 AND w = 0 AND n >= 25) OR (m = 9 AND w = 0 AND n <= 7) OR (m = 10 AND w = 0 AND n BETWEEN 8 AND 14) OR (m = 11 AND w = 3 AND n BETWEEN 22 AND 28)
  OR EXISTS (SELECT 1 FROM f WHERE year(d) >= since AND ((w < 5 AND m = fm AND n = fd) OR (w = 4 AND month(d + 1) = fm AND day(d + 1) = fd) OR (w = 0 AND month(d - 1) = fm AND day(d - 1) = fd))) AS is_holiday,
  (d + INTERVAL 1 MONTH)::DATE AS next_month, (date_diff('day', d, DATE '2001-12-31'))::INT AS days_left FROM o""",
)
def season_holiday_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = with_calendar(table(spark, sf_dir, "orders"), "o_orderdate")
    return o.select("o_orderkey", "season", (F.col("is_weekend") == 1).alias("is_weekend"), is_us_holiday(F.col("o_orderdate")).alias("is_holiday"), F.add_months(F.to_date("o_orderdate"), 1).alias("next_month"), F.date_diff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")).alias("days_left"))


@query(
    "business_features",
    f"""WITH {H} SELECT event_type, hour_ts, round(price * price, 6) AS price_sq, greatest(price - 55, 0) AS over_degree, greatest(45 - price, 0) AS under_degree,
  CASE WHEN price > 60 THEN 60 WHEN price < 40 THEN 40 ELSE price END AS held, load - lag(load) OVER (PARTITION BY event_type ORDER BY hour_ts) AS load_gap FROM h""",
)
def business_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    price, w = F.col("price"), Window.partitionBy("event_type").orderBy("hour_ts")
    return _hours(spark, sf_dir).select(
        "event_type", "hour_ts", F.round(price * price, 6).alias("price_sq"), clip(price - 55, 0.0).alias("over_degree"), clip(45 - price, 0.0).alias("under_degree"),
        clip(price, 40.0, 60.0).alias("held"), (F.col("load") - F.lag("load").over(w)).alias("load_gap"),
    )


@query(
    "actuals_backfill",
    """WITH p AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, max(value) AS predicted FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
a AS (SELECT event_type, date_trunc('hour', ts) AS hour_ts, arg_max(value, event_id) AS actual FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT event_type, hour_ts, predicted, actual, actual - predicted AS bias, abs(actual - predicted) AS abs_error, round(abs(actual - predicted) / greatest(abs(actual), 1e-9) * 100, 6) AS pct_error
FROM p LEFT JOIN a USING (event_type, hour_ts)""",
)
def actuals_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import hour_of
    from ..operators.keys import updated
    from ..operators.metrics import with_errors

    events = table(spark, sf_dir, "events")
    hour = hour_of("ts").alias("hour_ts")
    tracking = events.where("event_id % 2 = 0").groupBy("event_type", hour).agg(F.max("value").alias("predicted")).withColumn("actual", F.lit(None).cast("double"))
    actuals = events.where("event_id % 2 = 1").groupBy("event_type", hour).agg(F.max_by("value", "event_id").alias("value"))
    out = with_errors(updated(tracking, actuals, ["event_type", "hour_ts"], {"actual": "value"}), "predicted", "actual")
    return out.withColumn("pct_error", F.round("pct_error", 6))


@query(
    "day_or_last",
    f"""WITH {H}, k AS (SELECT *, bool_or(hour_ts::DATE = DATE '2024-01-29') OVER (PARTITION BY event_type) AS has_day, row_number() OVER (PARTITION BY event_type ORDER BY hour_ts DESC) AS n FROM h WHERE event_type <> 'view' OR hour_ts < TIMESTAMP '2024-01-20')
SELECT event_type, hour_ts, price FROM k WHERE CASE WHEN has_day THEN hour_ts::DATE = DATE '2024-01-29' ELSE n <= 24 END""",
)
def day_or_last_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Views end on the 19th here, so their last rows stand in for the day.
    hours = _hours(spark, sf_dir).where("event_type <> 'view' or hour_ts < timestamp_ntz'2024-01-20'")
    return day_or_last(hours, "event_type", "hour_ts", dt.date(2024, 1, 29)).select("event_type", "hour_ts", "price")


_ONE = "(ORDER BY ts, event_id)"


def _one_rolled(n: int) -> str:
    return _rolled("value", n).replace("PARTITION BY event_type ORDER BY hour_ts", "ORDER BY ts, event_id")


@query(
    "one_series_features",
    f"""SELECT event_id, {", ".join(f"lag(value, {k}) OVER {_ONE} AS value_lag_{k}" for k in (1, 24, 168))}, {_one_rolled(24)}, {_one_rolled(168)},
  abs(value - lag(value) OVER {_ONE}) AS abs_step, (epoch_us(ts) - epoch_us(lag(ts) OVER {_ONE})) AS gap_us FROM events""",
)
def one_series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    rows = haloed(events, ["ts", "event_id"], before=168, size=5000)
    out = with_rolling(with_lags(rows, "_block", "_number", {"value": [1, 24, 168]}), "_block", "_number", ["value"], [24, 168])
    out = with_step(with_step(out, "_block", "_number", "value"), "_block", "_number", "us", "gap_us").where("not _copy")
    out = out.withColumns({c: F.round(c, 8) for c in out.columns if "_roll_mean_" in c or "_roll_std_" in c})
    return out.drop("_block", "_number", "_copy", "ts", "value", "us")
