"""Forecast errors: daily figures, error memory with tiered lookup, intervals, drift, retraining and promotion rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

from ..functions.columns import clip, exact_mean, exact_sum, percent_error, rmse
from .keys import best_per_key
from .quantiles import quantiles, quantiles_of_counts, value_counts

#: Fixed values of the rules.
DRIFT = {"least_samples": 24, "times_baseline": 1.2, "most_rmse": 80.0}
RETRAIN = {"times_month": 1.2, "peak_rmse": 35.0, "peak_days": 3, "times_spike": 1.15, "most_days": 14}
PROMOTE = {"rmse": 0.97, "peak": 1.0, "spike": 1.05}


def with_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Adds bias (actual - predicted), abs_error and pct_error; null where either is."""
    d = F.col(actual) - F.col(predicted)
    return df.withColumns({"bias": d, "abs_error": F.abs(d), "pct_error": percent_error(predicted, actual)})


def error_figures(df: DataFrame, keys: Sequence[str], peak: Column, spike: Column) -> DataFrame:
    """n, mae, rmse, mape, peak_rmse and spike_rmse of rows with errors, by keys; a group without peak rows has a null there."""
    return df.where("bias is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), exact_mean("abs_error").alias("mae"), rmse("bias").alias("rmse"), exact_mean("pct_error", 12).alias("mape"),
        rmse(F.when(peak, F.col("bias"))).alias("peak_rmse"), rmse(F.when(spike, F.col("bias"))).alias("spike_rmse"),
    )


def regression_figures(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """n, mae, rmse, mape (zero actuals count as 1e-6) and r2 of rows with both values; r2 is null if actuals don't vary."""
    p, a = F.col(predicted).cast("double"), F.col(actual).cast("double")
    both = df.where(p.isNotNull() & a.isNotNull())
    err = F.abs(a - p) / F.abs(F.when(a == 0, F.lit(1e-6)).otherwise(a)) * 100
    square = F.sum(((a - p) * (a - p)).cast("decimal(38,4)")).cast("double")
    total = F.sum((a * a).cast("decimal(38,4)")).cast("double") - F.pow(F.sum(a.cast("decimal(18,2)")).cast("double"), 2) / F.count("*")
    return both.groupBy(*keys).agg(
        F.count("*").alias("n"), exact_mean(F.abs(a - p)).alias("mae"), F.sqrt(square / F.count("*")).alias("rmse"),
        exact_mean(err, 12).alias("mape"), F.when(total > 0, 1 - square / total).alias("r2"),
    )


def error_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """error_memory without the medians, for lookups and means that don't read them: one grouping of the errors."""
    n = F.count("*")
    return df.where(F.nanvl(F.col("bias"), F.lit(None)).isNotNull()).groupBy(*keys).agg(
        n.alias("sample_count"), exact_mean(F.abs("bias")).alias("mae"), rmse("bias").alias("rmse"), exact_mean("bias").alias("bias_mean"),
        F.count(F.when(F.col("bias") < 0, 1)).alias("over_count"), F.count(F.when(F.col("bias") > 0, 1)).alias("under_count"),
    )


def error_memory(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bias of past forecasts by keys (null keys are a group): sample_count, mae, rmse, mean, median, over and under counts."""
    # Each different bias of a key is one row of counts, from which both the figures and the median come: errors are read once.
    counts = value_counts(df, keys, "bias")
    each = counts.withColumn("_abs", F.abs("_v"))

    def total(x: Column, places: int) -> Column:
        return exact_sum(x, places, F.col("_n"))

    n = F.sum("_n")
    figures = each.groupBy(*[c for c in counts.columns if c.startswith("_k")]).agg(
        n.alias("sample_count"), (total(F.col("_abs"), 2) / n).alias("mae"), F.sqrt(total(F.col("_v") * F.col("_v"), 4) / n).alias("rmse"), (total(F.col("_v"), 2) / n).alias("bias_mean"),
        F.coalesce(F.sum(F.when(F.col("_v") < 0, F.col("_n"))), F.lit(0)).alias("over_count"), F.coalesce(F.sum(F.when(F.col("_v") > 0, F.col("_n"))), F.lit(0)).alias("under_count"),
    )
    figures = figures.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})
    medians = quantiles_of_counts(counts, keys, {"bias_median": 0.5}).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return figures.join(medians, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def tiered_lookup(rows: DataFrame, memory: DataFrame, tiers: Sequence[Sequence[str]], value: str, least_samples: int = 10, name: str = "found", most_entries: int | None = None) -> DataFrame:
    """rows with, from memory, the value of the first tier of keys that has an entry of enough samples, and that tier.

    Within a tier the entry of most samples counts, then the smallest value. Adds <name>, <name>_tier
    and <name>_samples, null where no tier has any. Each tier is one equality join with memory's best
    entry for those keys, so rows never multiply. most_entries: how many different keys memory can have,
    if their domain says so; up to 100,000 of them are broadcast, so that rows are not shuffled by a few hours.
    """
    enough = memory.where(F.col("sample_count") >= least_samples)
    if len(tiers) > 1:  # read by each tier, computed once
        enough = stored(enough)
    out = rows
    for i, keys in enumerate(tiers):
        best = best_per_key(enough, keys, F.col("sample_count").desc(), F.col(value))
        best = best.select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.struct(F.col(value).alias("v"), F.lit(i + 1).alias("t"), F.col("sample_count").alias("n")).alias(f"_e{i}"))
        best = F.broadcast(best) if most_entries is not None and most_entries <= 100_000 else best
        out = out.join(best, [F.col(k) == F.col(f"_k{i}_{k}") for k in keys], "left").drop(*[f"_k{i}_{k}" for k in keys])
    hit = F.coalesce(*[F.col(f"_e{i}") for i in range(len(tiers))])
    out = out.withColumns({name: hit.getField("v"), f"{name}_tier": hit.getField("t"), f"{name}_samples": hit.getField("n")})
    return out.drop(*[f"_e{i}" for i in range(len(tiers))])


def bias_corrected(rows: DataFrame, price: str, bias: str, most: float = 10.0) -> DataFrame:
    """Adds adjustment (the bias, held within ±most; 0 for null) and corrected (price plus that, not under 0)."""
    adjustment = F.coalesce(clip(bias, -most, most), F.lit(0.0))
    return rows.withColumn("adjustment", adjustment).withColumn("corrected", clip(F.col(price) + F.col("adjustment"), 0.0))


def residual_intervals(forecast: DataFrame, residuals: DataFrame, key: Sequence[str], price: str, residual: str = "residual") -> DataFrame:
    """Adds lower and upper: price plus the P10 and P90 of past residuals of the row's key, of all residuals where the key has none."""
    own = quantiles(residuals, key, residual, {"_p10": 0.1, "_p90": 0.9})
    whole = quantiles(residuals, [], residual, {"_all10": 0.1, "_all90": 0.9})
    joined = forecast.join(own, list(key), "left").join(F.broadcast(whole), F.lit(True), "left")
    bounds = {"lower": F.col(price) + F.coalesce("_p10", "_all10"), "upper": F.col(price) + F.coalesce("_p90", "_all90")}
    return joined.withColumns(bounds).drop("_p10", "_p90", "_all10", "_all90")


def weighted_bias(memory: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples, mean bias weighted by samples (1 at least), and plain means of peak and of high-risk entries."""
    n = F.greatest(F.coalesce("sample_count", F.lit(0)), F.lit(1)).cast("decimal(18,0)")
    weighted = F.sum((F.coalesce("bias_mean", F.lit(0.0)).cast("decimal(18,6)") * n).cast("decimal(38,6)")).cast("double") / F.sum(n).cast("double")
    return memory.groupBy(*keys).agg(
        F.sum("sample_count").alias("sample_count"), weighted.alias("avg_bias"),
        exact_mean(F.when(F.col("is_peak_hour") == 1, F.col("bias_mean")), "decimal(28,8)").alias("peak_avg_bias"),
        exact_mean(F.when(F.col("risk_level").isin("high", "spike"), F.col("bias_mean")), "decimal(28,8)").alias("spike_avg_bias"),
    )


def drift(n: Column, recent: Column, baseline: Column) -> Column:
    """'insufficient_data', 'degraded', 'high_error' or 'healthy', from a recent window's samples and RMSE and a baseline RMSE."""
    worse = F.coalesce((baseline > 0) & (recent > DRIFT["times_baseline"] * baseline), F.lit(False))
    short = F.coalesce(n, F.lit(0)) < DRIFT["least_samples"]
    return F.when(short, "insufficient_data").when(worse, "degraded").when(recent > DRIFT["most_rmse"], "high_error").otherwise("healthy")


def retrain_reasons(daily: DataFrame, key: str, as_of: Column, spike_base: Column, trained: Column) -> DataFrame:
    """(key, n_7d, rmse_7d, rmse_30d, reasons, should_retrain) from daily figures up to as_of.

    Means are of the days' figures. 'peak' needs the three oldest of the last seven days above the
    limit: that is how the rule reads days that come newest first. spike_base is the trained model's
    spike RMSE, trained its day; null turns the rule about it off ('untrained' for the day).
    """
    d, days = F.col("day"), daily.withColumn("_as_of", as_of)
    week, month = d >= F.date_sub("_as_of", 7), d >= F.date_sub("_as_of", 30)
    oldest = F.slice(F.array_sort(F.collect_list(F.when(week, F.struct("day", F.coalesce("peak_rmse", F.lit(0.0)).alias("x"))))), 1, RETRAIN["peak_days"])

    def mean(c: str, when: Column) -> Column:
        return exact_mean(F.when(when, F.col(c)), "decimal(28,8)")

    got = days.groupBy(key, "_as_of").agg(
        F.coalesce(F.sum(F.when(week, F.col("n"))), F.lit(0)).alias("n_7d"), mean("rmse", week).alias("rmse_7d"), mean("rmse", month).alias("rmse_30d"),
        mean("spike_rmse", week).alias("_spike"), oldest.alias("_peaks"), F.max(spike_base).alias("_spike_base"), F.max(trained).alias("_trained"),
    )
    peaks = (F.size("_peaks") >= RETRAIN["peak_days"]) & F.forall("_peaks", lambda x: x.getField("x") > RETRAIN["peak_rmse"])
    reasons = F.array_compact(F.array(
        F.when(F.col("rmse_7d") > RETRAIN["times_month"] * F.col("rmse_30d"), "rmse"), F.when(peaks, "peak"),
        F.when(F.col("_spike") > RETRAIN["times_spike"] * F.col("_spike_base"), "spike"),
        F.when(F.col("_trained").isNull(), "untrained").when(F.date_diff("_as_of", "_trained") > RETRAIN["most_days"], "age"),
    ))
    return got.select(key, "n_7d", "rmse_7d", "rmse_30d", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) > 0).alias("should_retrain"))


def promotes(candidate: tuple[Column, Column, Column], active: tuple[Column, Column, Column]) -> Column:
    """Whether a candidate's (rmse, peak, spike) may take the active one's place; false where a figure is missing."""
    ok = F.lit(True)
    for c, a, factor in zip(candidate, active, PROMOTE.values(), strict=True):
        ok = ok & F.coalesce(c <= a * factor, F.lit(False))
    return ok


def strategy_score(error: Column, peak: Column, spike: Column) -> Column:
    """1 / (1 + rmse + peak / 4 + spike / 4); missing figures count 0."""
    zero = F.lit(0.0)
    return 1 / (1 + F.coalesce(error, zero) + 0.25 * F.coalesce(peak, zero) + 0.25 * F.coalesce(spike, zero))


def preferred_else_best(df: DataFrame, keys: Sequence[str], preferred: Column, *order: Column) -> DataFrame:
    """For each key the preferred row if there is one, else the best by order."""
    return best_per_key(df, keys, F.coalesce(preferred, F.lit(False)).desc(), *order)


def fold_summary(folds: DataFrame, keys: Sequence[str], fold: str, error: str) -> DataFrame:
    """Number of folds, their mean error, and the worst fold (of equal ones the smallest name)."""
    worst = F.min_by(fold, F.struct(-F.col(error), F.col(fold)))
    return folds.where(F.col(error).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_folds"), exact_mean(error, "decimal(28,8)").alias("mean_error"), F.max(error).alias("worst_error"), worst.alias("worst_fold"))


def time_split(df: DataFrame, key: str, ts: str, days: int = 30) -> DataFrame:
    """Adds part: 'test' for the last days of each series, else 'train'. Rows are not shuffled where the series' ends are few enough to be broadcast."""
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max(ts).alias("_last"))
    test = F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS")
    return df.join(last, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("part", F.when(test, "test").otherwise("train")).drop("_key", "_last")
