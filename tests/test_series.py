import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.calendar import is_us_holiday, with_calendar
from tidemark.functions.columns import level
from tidemark.operators import keys, series
from tidemark.operators.metrics import residual_intervals
from tidemark.operators.quantiles import quantiles, with_quantiles
from tidemark.operators.risk import tertile


def at(day, hour=0):
    return dt.datetime.fromisoformat(day) + dt.timedelta(hours=hour)


def test_standardize_drops_bad_times_and_keeps_first(spark):
    rows = [("2026-01-02 01:00", 2), ("bad-date", 99), ("2026-01-02 00:00", 1), ("2026-01-02 00:00", 3)]
    df = spark.createDataFrame([(t, v, i) for i, (t, v) in enumerate(rows)], "t string, value int, seq int")
    df = df.withColumn("datetime", F.expr("cast(try_to_timestamp(t, 'yyyy-MM-dd HH:mm') as timestamp_ntz)"))
    got = series.standardized(df, "datetime", "seq").orderBy("datetime").select("datetime", "value").collect()
    assert [tuple(r) for r in got] == [(at("2026-01-02"), 1), (at("2026-01-02", 1), 2)]


def test_rolling_needs_all_values(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "k string, i int, price double")
    got = [r[0] for r in series.with_rolling(df, "k", "i", ["price"], [2]).orderBy("i").select("price_roll_mean_2").collect()]
    assert got == [None, None, 1.5, None, None, 4.5]


def test_day_ahead_vintage(spark):
    made = [("2026-01-01", 8, "2026-01-02", 5, 10), ("2026-01-01", 20, "2026-01-02", 5, 11), ("2026-01-02", 3, "2026-01-02", 5, 12)]
    made += [("2025-12-31", 10, "2026-01-02", 6, 20), ("2026-01-02", 2, "2026-01-02", 6, 21), ("2026-01-02", 7, "2026-01-02", 6, 22)]
    df = spark.createDataFrame([("a", at(d, h), at(e, g), v) for d, h, e, g, v in made], "area string, made timestamp_ntz, target timestamp_ntz, load int")
    got = {r["target"].hour: r["load"] for r in series.day_ahead_vintage(df, ["area"], "target", "made", "load").collect()}
    assert got == {5: 11, 6: 21}


def test_union_keeps_first_or_new(spark):
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 10), (2, 20)], [(2, 99), (3, 30)]))
    assert {r["k"]: r["v"] for r in keys.union_keep(old, new, ["k"]).collect()} == {1: 10, 2: 20, 3: 30}
    assert {r["k"]: r["v"] for r in keys.union_keep(old, new, ["k"], "new").collect()} == {1: 10, 2: 99, 3: 30}


def test_complete_until(spark):
    df = spark.createDataFrame([("a", at("2026-01-01", 10)), ("b", at("2026-01-01", 9)), ("c", at("2026-01-01", 8))], "s string, t timestamp_ntz")
    sources = {n: F.col("s") == n for n in "abc"}
    assert [r["s"] for r in series.complete_until(df, "t", sources).collect()] == ["c"]
    assert series.complete_until(df, "t", sources | {"none": F.col("s") == "x"}).count() == 0


def test_resume_from_empty_is_the_floor(spark):
    floor = F.lit("2026-01-01").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "t timestamp_ntz")
    assert series.resume_from(empty, "t", floor).first()[0] == at("2026-01-01")


def test_residual_intervals(spark):
    forecast = spark.createDataFrame([(0, 100.0), (1, 110.0), (9, 50.0)], "hour int, predicted double")
    past = spark.createDataFrame(list(enumerate([1.0, 4.0, -2.0, 1.0, 4.0, -2.0])), "hour int, residual double")
    got = {r["hour"]: (r["lower"], r["upper"]) for r in residual_intervals(forecast, past, ["hour"], "predicted").collect()}
    assert got == {0: (101.0, 101.0), 1: (114.0, 114.0), 9: (48.0, 54.0)}


def test_calendar_and_holidays(spark):
    days = [("2026-07-03", True), ("2026-07-04", False), ("2021-06-18", True), ("2020-06-19", False), ("2026-01-19", True), ("2026-11-26", True), ("2021-12-31", True), ("2026-05-25", True), ("2026-05-18", False)]
    df = spark.createDataFrame([(at(d), w) for d, w in days], "t timestamp_ntz, want boolean")
    assert df.where(is_us_holiday(F.col("t")) != F.col("want")).count() == 0
    row = with_calendar(spark.createDataFrame([(at("2026-01-03", 7),)], "t timestamp_ntz"), "t").first()
    assert (row["hour"], row["day_of_week"], row["is_weekend"], row["is_peak_hour"], row["season"]) == (7, 5, 1, 1, "winter")


def test_levels_and_tertiles(spark):
    df = spark.createDataFrame([(0.5,), (0.2,), (0.1,), (None,)], "p double")
    assert [r[0] for r in df.select(level("p")).collect()] == ["high", "medium", "low", "low"]
    few = with_quantiles(spark.createDataFrame([(1.0,), (2.0,)], "x double"), [], "x", {"a": 0.33, "b": 0.66})
    assert {r[0] for r in few.select(tertile(F.col("x"), F.lit(2), F.col("a"), F.col("b"))).collect()} == {"unknown"}


def test_priority_union(spark):
    def ranked(items):
        return spark.createDataFrame([("g", t, i) for i, t in enumerate(items, 1)], "g string, t string, place int")

    got = keys.priority_union([ranked(["t1", "t2"]), ranked(["t2", "t3"]), ranked(["t4", "t1"])], ["t"], 6, ["g"])
    assert [r["t"] for r in got.orderBy("focus_place").collect()] == ["t1", "t2", "t3", "t4"]


def test_soft_match_passes_over_empty_conditions(spark):
    rules = spark.createDataFrame([("P", "A", 1), ("P", "B", 2)], "province string, city string, id int")
    city = lambda c: keys.soft_match(rules, ["province"], [F.col("city") == c], F.col("id")).first()["id"]
    assert (city("C"), city("B")) == (1, 2)


def test_quantiles_are_numpys(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 77).astype(float), None: np.array([5.0]), "skew": np.r_[rng.random(50), 1e12]}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    points = {"p0": 0.0, "p10": 0.1, "p33": 0.33, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: [r[p] for p in points] for r in quantiles(df, ["k"], "x", points).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, list(points.values())), rtol=1e-12, atol=0)
    whole = quantiles(df, [], "x", points).first()
    assert np.allclose(list(whole), np.quantile(np.concatenate(list(groups.values())), list(points.values())), rtol=1e-12)
    assert set(quantiles(df.limit(0), [], "x", points).first()) == {None} and quantiles(df.limit(0), ["k"], "x", points).count() == 0
    assert with_quantiles(df, ["k"], "x", points).where("k = 'none' and p50 is null").count() == 1
