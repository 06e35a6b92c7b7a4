"""Calendar parts of timestamps, and holidays by rule, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import recode

#: Hours that count as peak; the second set also has hour 6.
PEAK_HOURS = (7, 8, 9, 10, 11, 18, 19, 20, 21)
WIDE_PEAK_HOURS = (6, 7, 8, 9, 10, 11, 18, 19, 20, 21)
#: Months by season.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}


def with_calendar(df: DataFrame, ts: str, peak: tuple[int, ...] = PEAK_HOURS) -> DataFrame:
    """df with hour, day_of_week (Monday 0), month, day, year, is_weekend, is_peak_hour (0/1) and season; null for a null ts, flags 0."""
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "day": F.day(t), "year": F.year(t),
        "is_weekend": F.when(F.weekday(t) >= 5, 1).otherwise(0), "is_peak_hour": F.when(F.hour(t).isin(*peak), 1).otherwise(0),
        "season": recode(F.month(t), SEASONS),
    })


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of x in turns of period."""
    angle = 2 * F.pi() * x / period
    return F.sin(angle), F.cos(angle)


def _observed(d: Column, month: int, day: int) -> Column:
    """d is this day, or the Friday or Monday on which it is kept if it falls on a weekend."""

    def on(x: Column) -> Column:
        return (F.month(x) == month) & (F.day(x) == day)

    w = F.weekday(d)
    return (on(d) & (w < 5)) | ((w == 4) & on(F.date_add(d, 1))) | ((w == 0) & on(F.date_sub(d, 1)))


def is_us_holiday(ts: Column) -> Column:
    """Whether the day is a US federal holiday, by the rules that hold since 1986 (Juneteenth since 2021); null for null."""
    d = F.to_date(ts)
    m, n, w = F.month(d), F.day(d), F.weekday(d)
    moving = (
        ((m == 1) & (w == 0) & n.between(15, 21)) | ((m == 2) & (w == 0) & n.between(15, 21)) | ((m == 5) & (w == 0) & (n >= 25))
        | ((m == 9) & (w == 0) & (n <= 7)) | ((m == 10) & (w == 0) & n.between(8, 14)) | ((m == 11) & (w == 3) & n.between(22, 28))
    )
    june = _observed(d, 6, 19) & (F.year(d) >= 2021)
    return moving | _observed(d, 1, 1) | june | _observed(d, 7, 4) | _observed(d, 11, 11) | _observed(d, 12, 25)
