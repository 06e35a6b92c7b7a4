"""Risk of hours: thresholds from quantiles, levels, scores, reasons and advice. One row in, expressions out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import level
from .quantiles import with_quantiles


def data_level(price: Column, probability: Column, p90: Column, p75: Column) -> Column:
    """Level by price against its own quantiles, or by probability (0.4 and 0.15)."""
    high = F.coalesce(price >= p90, F.lit(False)) | F.coalesce(probability >= 0.4, F.lit(False))
    medium = F.coalesce(price >= p75, F.lit(False)) | F.coalesce(probability >= 0.15, F.lit(False))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def tertile(x: Column, n: Column, third: Column, two_thirds: Column, least: int = 10) -> Column:
    """'low' up to the first point, 'mid' up to the second, 'high' above; 'unknown' with under `least` values, or for null."""
    return F.when((n < least) | x.isNull(), "unknown").when(x <= third, "low").when(x <= two_thirds, "mid").otherwise("high")


def score(price: Column, p75: Column, probability: Column, peak: Column, text: Column | None = None) -> Column:
    """Points: 3 for a high and 1 for a medium level, 1.2 for a price from p75 on, 2 for a probability from 0.5 on, 0.5 for a peak hour."""

    def points(x: Column, n: float) -> Column:
        return F.when(x, F.lit(n)).otherwise(F.lit(0.0))

    text = level(probability) if text is None else text
    return F.round(points(text == "high", 3.0) + points(text == "medium", 1.0) + points(price >= p75, 1.2) + points(probability >= 0.5, 2.0) + points(peak == 1, 0.5), 2)


def reasons(price: Column, p75: Column, probability: Column, peak: Column, load: Column, load75: Column) -> Column:
    """Names of the rules that hold, in order: price, spike, peak, load."""
    rules = {"price": price >= p75, "spike": probability >= 0.5, "peak": peak == 1, "load": load >= load75}
    return F.array_compact(F.array(*[F.when(x, n) for n, x in rules.items()]))


def explained(df: DataFrame, *args: Column) -> DataFrame:
    """Rows with any reason (args as for reasons), with risk_level, anomaly_type and explanation ('price; spike')."""
    probability = args[2]
    out = df.withColumn("_reasons", reasons(*args)).where(F.size("_reasons") > 0)
    risk = F.when(F.coalesce(probability >= 0.5, F.lit(False)), "high").when(F.coalesce(args[0] >= args[1], F.lit(False)), "medium").otherwise("low")
    out = out.withColumns({"risk_level": risk, "explanation": F.array_join("_reasons", "; ")})
    return out.withColumn("anomaly_type", F.when(F.col("risk_level") == "high", "price, spike or peak load").otherwise("high price")).drop("_reasons")


def ranked(df: DataFrame, keys: Sequence[str], most: int, *order: Column) -> DataFrame:
    """Each key's first rows in this order, which should be total, with their place from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= most)


def advice(df: DataFrame, price: Column, p25: Column, p75: Column, probability: Column, peak: Column, load: Column, load75: Column) -> DataFrame:
    """None to four rows for each row: advice_type, risk_level, must_watch."""

    def item(when: Column, kind: str, risk: Column | str, watch: bool) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("advice_type"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk_level"), F.lit(watch).alias("must_watch")))

    items = F.array_compact(F.array(
        item(price >= p75, "high price", F.when(probability >= 0.5, "high").otherwise("medium"), True), item(price <= p25, "low price window", "low", False),
        item(probability >= 0.5, "manual review", "high", True), item((peak == 1) & (load >= load75), "peak load", "medium", True),
    ))
    return df.withColumn("_item", F.explode(items)).select("*", "_item.*").drop("_item")


def storage_windows(df: DataFrame, keys: Sequence[str], price: str, tie: str, most: int = 5) -> DataFrame:
    """Charge rows (price up to its p25, cheapest first) and discharge rows (from p75, dearest first), `most` of each for each key."""
    q = with_quantiles(df.where(F.col(price).isNotNull()), keys, price, {"p25": 0.25, "p75": 0.75})
    low = ranked(q.where(F.col(price) <= F.col("p25")), keys, most, F.col(price).asc(), F.col(tie)).withColumn("action", F.lit("charge"))
    high = ranked(q.where(F.col(price) >= F.col("p75")), keys, most, F.col(price).desc(), F.col(tie)).withColumn("action", F.lit("discharge"))
    return low.unionByName(high)


def overall(df: DataFrame, keys: Sequence[str], probability: str, price: str, p75: str) -> DataFrame:
    """(keys, n_high, most_probability, overall): high with three hours of a probability from 0.5 on or one from 0.8 on;
    medium-high with one such hour; medium if a price reaches p75; else low."""
    got = df.groupBy(*keys).agg(F.count(F.when(F.col(probability) >= 0.5, 1)).alias("n_high"), F.coalesce(F.max(probability), F.lit(0.0)).alias("most_probability"), F.max(F.col(price) >= F.col(p75)).alias("_dear"))
    grade = F.when((F.col("n_high") >= 3) | (F.col("most_probability") >= 0.8), "high").when(F.col("n_high") >= 1, "medium-high").when(F.col("_dear"), "medium").otherwise("low")
    return got.withColumn("overall", grade).drop("_dear")


def confidence(error: Column) -> Column:
    """1 - rmse / 100, from 0.05 to 0.95; null for null."""
    return F.when(error.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - error / 100)))
