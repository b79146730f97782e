"""Scalar and aggregate functions whose semantics differ between engines, pinned down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column | str) -> Column:
    """Skewness of a sample (bias-corrected), from Spark's population skewness; null under three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column | str) -> Column:
    """Excess kurtosis of a sample (bias-corrected); null under four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def weekday(ts: Column | str) -> Column:
    """Day of the week, Sunday 0 to Saturday 6."""
    return F.dayofweek(ts) - 1


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, element by element inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bucket_of(x: Column | str, low: float, high: float, n: int) -> Column:
    """Equal-width histogram bucket 1..n; 0 below and n + 1 at or above the range."""
    return F.width_bucket(x if isinstance(x, Column) else F.col(x), F.lit(low), F.lit(high), F.lit(n))
