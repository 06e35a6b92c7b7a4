"""Column expressions: lenient casts, recoding, clipping, percent errors. All run inside whole-stage code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Name) -> Column:
    """x as double; what is no number, NaN and infinities become null."""
    d = _col(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def number_with_commas(x: Name) -> Column:
    """Like number, for text such as ' 1,234.5 '."""
    return number(F.replace(F.trim(_col(x).cast("string")), F.lit(","), F.lit("")))


def moment(x: Name, form: str | None = None) -> Column:
    """x as a timestamp without zone; what can't be read becomes null."""
    t = F.try_to_timestamp(_col(x).cast("string"), F.lit(form)) if form else F.try_to_timestamp(_col(x).cast("string"))
    return t.cast("timestamp_ntz")


def hour_of(ts: Name) -> Column:
    """The hour a timestamp without zone lies in, again without zone."""
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def day_of(ts: Name) -> Column:
    return F.to_date(_col(ts))


def present(df: DataFrame, names: Sequence[str], part: str | None = None) -> str | None:
    """The first of names that df has; else its first column whose name contains part, case ignored; else None."""
    for n in names:
        if n in df.columns:
            return n
    return next((c for c in df.columns if part and part.lower() in c.lower()), None)


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first value that isn't null among those of names that df has; null if it has none of them."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def reindexed(df: DataFrame, names: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Just the named columns as doubles, in that order; absent columns and missing values are fill."""
    return df.select(*[F.coalesce(number(f"`{n}`"), F.lit(fill)).alias(n) if n in df.columns else F.lit(fill).alias(n) for n in names])


def recode(x: Name, values: Mapping, default=None) -> Column:
    """values[x]; default for other values and null."""
    out, x = F.lit(default), _col(x)
    for k, v in reversed(list(values.items())):
        out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
    return out


def level(x: Name, high: float | Column = 0.5, medium: float | Column = 0.2) -> Column:
    """'high' from high on, 'medium' from medium on, else 'low'; null counts as low."""
    x = _col(x)
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def clip(x: Name, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x between low and high; null stays null (least and greatest alone would skip it)."""
    x = y = _col(x)
    if high is not None:
        y = F.least(y, F.lit(high))
    if low is not None:
        y = F.greatest(y, F.lit(low))
    return F.when(x.isNotNull(), y)


def finite(x: Name) -> Column:
    """Null in place of NaN and infinities."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def percent_error(predicted: Name, actual: Name, floor: float = 1e-9) -> Column:
    """|actual - predicted| in percent of |actual|, of floor at least; null if either is."""
    p, a = _col(predicted), _col(actual)
    return F.when(p.isNotNull() & a.isNotNull(), F.abs(a - p) / F.greatest(F.abs(a), F.lit(floor)) * 100)


def percent_change(new: Name, old: Name) -> Column:
    """From old to new in percent; null where old is null or 0."""
    new, old = _col(new), _col(old)
    return F.when(old != 0, (new - old) / old * 100)


def money(x: Name) -> Column:
    """Exact to two places, so that sums don't depend on the order of rows."""
    return _col(x).cast("decimal(18,2)")


def exact_sum(x: Name, places: int, times: Column | None = None) -> Column:
    """Sum, as a double, of x rounded to places (halves away from 0), the same on any partitioning; null if no row has a value.

    Values under 2**53 units are added up as two long integers each, their high and their low 26 bits, which is exact for
    some 10**11 rows a group; larger ones as decimals. Decimals of 38 digits alone cost several times as much a row.
    times: how many rows a row stands for.
    """
    x = _col(x).cast("double")
    units = x * F.lit(10.0**places)
    fits = F.abs(units) < F.lit(2.0**53)
    near = F.when(fits, F.when(units < 0, -F.floor(0.5 - units)).otherwise(F.floor(units + 0.5)))
    zero = F.lit(0).cast("bigint")
    high, low = F.shiftright(near, 26), near.bitwiseAND(F.lit((1 << 26) - 1).cast("bigint"))
    big = F.when(~fits, x.cast(f"decimal(38,{places})"))
    if times is not None:
        high, low, big = high * times, low * times, big * times.cast("decimal(18,0)")
    high, low = F.coalesce(F.sum(high), zero), F.coalesce(F.sum(low), zero)
    small = high.cast("decimal(20,0)") * F.lit(1 << 26).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    large = F.coalesce(F.sum(big).cast("double"), F.lit(0.0))
    return F.when(F.count(x) > 0, small.cast("double") / F.lit(10.0**places) + large)


def exact_mean(x: Name, kind: str | int = 2) -> Column:
    """Mean by an exact sum: the same on any partitioning. Skips nulls. kind: places kept of each value, or the decimal type that holds it."""
    x = _col(x)
    return (exact_sum(x, kind) if isinstance(kind, int) else F.sum(x.cast(kind)).cast("double")) / F.nullif(F.count(x), F.lit(0))


def rmse(x: Name) -> Column:
    """Square root of the mean square; skips nulls, null if all are."""
    x = _col(x)
    return F.sqrt(exact_sum(x * x, 4) / F.nullif(F.count(x), F.lit(0)))
