import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators.quantiles import quantiles


def test_point_and_window_errors(spark):
    df = m.with_errors(spark.createDataFrame([(90.0, 100.0), (110.0, 100.0), (1.0, None)], "p double, a double"), "p", "a")
    assert [(r["abs_error"], r["pct_error"]) for r in df.collect()] == [(10.0, 10.0), (10.0, 10.0), (None, None)]
    row = m.error_figures(df, [], F.lit(False), F.lit(False)).first()
    assert (row["n"], row["rmse"], row["peak_rmse"]) == (2, 10.0, None)


@pytest.mark.parametrize("n, recent, base, want", [(48, 130.0, 100.0, "degraded"), (10, 130.0, 100.0, "insufficient_data"), (48, 90.0, 100.0, "high_error"), (48, 50.0, 100.0, "healthy"), (None, None, None, "insufficient_data")])
def test_drift(spark, n, recent, base, want):
    df = spark.createDataFrame([(n, recent, base)], "n int, r double, b double")
    assert df.select(m.drift(F.col("n"), F.col("r"), F.col("b"))).first()[0] == want


def test_promotion(spark):
    one = lambda *x: tuple(F.lit(v).cast("double") for v in x)
    df = spark.range(1)
    assert df.select(m.promotes(one(96, 50, 52), one(100, 50, 50))).first()[0]
    assert not df.select(m.promotes(one(98, 50, 52), one(100, 50, 50))).first()[0]
    assert not df.select(m.promotes(one(96, None, 52), one(100, 50, 50))).first()[0]


def test_tiered_lookup_and_cap(spark):
    memory = spark.createDataFrame([(7, 1, 1, "high", 5, 9.0), (7, 2, 1, "normal", 30, 2.0), (7, 3, 0, "normal", 80, -4.0)], "hour int, dow int, peak int, risk string, sample_count int, bias_mean double")
    rows = spark.createDataFrame([(1, 7, 1, 1, "high"), (2, 7, 1, 0, "low"), (3, 8, 1, 1, "high")], "id int, hour int, dow int, peak int, risk string")
    found = m.tiered_lookup(rows, memory, [["hour", "dow", "peak", "risk"], ["hour", "peak"], ["hour"]], "bias_mean")
    assert {r["id"]: (r["found"], r["found_tier"]) for r in found.collect()} == {1: (2.0, 2), 2: (-4.0, 2), 3: (None, None)}
    prices = spark.createDataFrame([(5.0, -30.0), (50.0, 3.0), (1.0, None)], "price double, bias double")
    assert [(r["adjustment"], r["corrected"]) for r in m.bias_corrected(prices, "price", "bias").collect()] == [(-10.0, 0.0), (3.0, 53.0), (0.0, 1.0)]


@pytest.mark.parametrize("newest_first, fires", [([40, 40, 40, 10, 10, 10], False), ([10, 10, 10, 40, 40, 40], True)])
def test_retrain_reads_the_oldest_days(spark, newest_first, fires):
    as_of = dt.date(2026, 1, 10)
    rows = [("m", as_of - dt.timedelta(days=i), 10, 5.0, float(p), 1.0) for i, p in enumerate(newest_first)]
    daily = spark.createDataFrame(rows, "model string, day date, n long, rmse double, peak_rmse double, spike_rmse double")
    row = m.retrain_reasons(daily, "model", F.lit(as_of), F.lit(None).cast("double"), F.lit(as_of)).first()
    assert ("peak" in row["reasons"]) == fires and row["should_retrain"] == fires and row["n_7d"] == 60


def test_quantiles_with_an_outlier_and_a_hot_key(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [*rng.normal(size=3000), 1e30, -1e30, *[0.5] * 500]
    rows = [("hot", float(v)) for v in values] + [("one", 2.0), (None, 1.0), (None, 4.0), ("none", None)]
    got = {r["k"]: (r["a"], r["b"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.1, "b": 0.5}).collect()}
    assert got.keys() == {"hot", "one", None} and got["one"] == (2.0, 2.0) and got[None] == (1.3, 2.5)
    assert np.allclose(got["hot"], np.quantile(values, [0.1, 0.5]), rtol=1e-12)


def test_steps_are_cut_until_they_fit(spark, monkeypatch):
    import numpy as np

    from tidemark.operators import quantiles as q

    values = [float(v) for v in np.random.default_rng(5).permutation(9000)] + [77.0] * 500
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 3.0), ("none", float("nan"))], "k string, v double")
    monkeypatch.setattr(q, "STEPS", 8)
    monkeypatch.setattr(q, "MOST", 20)
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in q.quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.999}).collect()}
    assert got == {"a": tuple(np.quantile(values, [0.01, 0.5, 0.999]).tolist()), None: (3.0, 3.0, 3.0)} or np.allclose(got["a"], np.quantile(values, [0.01, 0.5, 0.999]), rtol=1e-12)
    assert got.keys() == {"a", None} and got[None] == (3.0, 3.0, 3.0)
    assert q.quantiles(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_exact_sums_of_small_large_and_negative_values(spark):
    from tidemark.functions.columns import exact_mean, exact_sum, rmse

    df = spark.createDataFrame([(0.125,), (-0.375,), (2.0**60,), (-(2.0**60),), (5e7,), (None,)], "x double")
    assert df.select(exact_sum("x", 2)).first()[0] == 0.13 - 0.38 + 5e7
    assert df.where("x < 1").where("x > -1").select(exact_mean("x"), rmse("x")).first() == ((0.13 - 0.38) / 2, ((0.0156 + 0.1406) / 2) ** 0.5)
    assert df.where("x is null").select(exact_sum("x", 2), exact_mean("x"), rmse("x")).first() == (None, None, None)
    n = spark.createDataFrame([(1.5, 3), (-2.25, 2)], "x double, n long")
    assert n.select(exact_sum("x", 2, F.col("n"))).first()[0] == 0.0


def test_error_memory_counts_each_bias(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", -4.0), ("m", None), (None, 2.0)], "k string, bias double")
    got = {r["k"]: r.asDict() for r in m.error_memory(df, ["k"]).collect()}
    assert got["m"] == {"k": "m", "sample_count": 3, "mae": 2.0, "rmse": 6.0**0.5, "bias_mean": -2 / 3, "bias_median": 1.0, "over_count": 1, "under_count": 2}
    assert got[None]["sample_count"] == 1 and got[None]["bias_median"] == 2.0 and m.error_memory(df.limit(0), ["k"]).count() == 0


def test_cuts_of_quantiles_are_taken_once(spark):
    """Taken again in the last plan, they may differ from those that the steps were chosen by."""
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id * 7919 % 1009 as double) as v")
    plan = quantiles(df, ["k"], "v", {"a": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


def test_error_counts_are_those_of_error_memory(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", -2.25), ("a", 1.5), ("b", 0.0), ("b", None), (None, 2.0), ("c", float("nan"))], "k string, bias double")
    got = m.error_counts(df, ["k"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, m.error_memory(df, ["k"]).drop("bias_median").collect()))
    # One grouping, one shuffle: no table of values by key, as the medians need.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("name", ["tiered_lookup_bias", "weighted_bias_summary"])
def test_lookups_take_no_medians(spark, name, monkeypatch):
    from tidemark.plans.registry import QUERIES, load

    load()
    monkeypatch.setattr(m, "quantiles_of_counts", lambda *_: pytest.fail("medians that nothing reads"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
