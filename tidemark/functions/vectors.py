"""Vectors as arrays of numbers: cosine and length, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine from 0 to 1 (negative ones are 0); 0 for vectors of different or no length, or of only zeros; null for null."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def normalized(a: Column) -> Column:
    """a at length 1; as it is if its length is 0."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))
