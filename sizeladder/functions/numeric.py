"""Scalar column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def is_finite(v: Column) -> Column:
    """True for a present, finite number; never NULL."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(_INF))


def all_finite(values: Column) -> Column:
    """True when every element of an array is finite."""
    return F.coalesce(F.forall(values, lambda v: is_finite(v)), F.lit(False))


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def clip(v: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip that leaves a missing value missing (``least``/``greatest`` would drop the NULL)."""
    out = v
    if lower is not None:
        out = F.when(out < lower, F.lit(float(lower))).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(float(upper))).otherwise(out)
    return out


def to_number_or_zero(text: Column) -> Column:
    """Parse text to a number; anything unusable, NaN included, becomes 0."""
    return F.coalesce(nan_to_null(text.try_cast("double")), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def standardise(values: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd by element; a zero spread counts as 1."""
    centred = F.zip_with(values, mean, lambda v, m: v - m)
    return F.zip_with(centred, sd, lambda v, s: v / F.when(s == 0, F.lit(1.0)).otherwise(s))


def power_law(t: Column, a: Column, b: Column, c: Column) -> Column:
    return a * F.pow(t, -b) + c


def log_grid(start: float, stop: Column | float, points: int = 100) -> Column:
    """Array of `points` logarithmically spaced numbers from `start` to `stop`, both included."""
    stop = stop if isinstance(stop, Column) else F.lit(float(stop))
    lo, hi = F.log10(F.lit(float(start))), F.log10(stop)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: F.pow(F.lit(10.0), lo + (hi - lo) * i / F.lit(float(points - 1))))
