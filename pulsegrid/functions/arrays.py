"""Statistics of array columns as built-in expressions; a null element makes a result null unless filtered before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for use inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zero() -> Column:
    return F.lit(0.0)


def moments(a: Column) -> Column:
    """struct(n, mean, m2), in one pass without cancellation; mean is 0 for an empty array."""
    start = F.struct(_zero().alias("n"), _zero().alias("mean"), _zero().alias("m2"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(a, start, step)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, _zero(), lambda s, x: s + x) / F.size(a))


def sd_pop(a: Column) -> Column:
    return F.when(F.size(a) > 0, let(moments(a), lambda s: F.sqrt(s["m2"] / s["n"])))


def has_null(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull())


def span(a: Column) -> Column:
    return F.when(~has_null(a), F.array_max(a) - F.array_min(a))


def ls_slope(a: Column, fs: float) -> Column:
    """Least-squares slope per second of evenly spaced values; null below two."""
    n = F.size(a)

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["i"] + 1).alias("i"), (s["sum"] + (s["i"] - (n - 1) / 2) * x).alias("sum"))

    start = F.struct(_zero().alias("i"), _zero().alias("sum"))
    return F.when(n >= 2, F.aggregate(a, start, step)["sum"] * fs * 12 / (n.cast("double") * (n.cast("double") * n - 1)))


def abs_integral(a: Column, fs: float) -> Column:
    """Integral of the distance from the mean."""
    return F.when(F.size(a) > 0, let(mean(a), lambda m: F.aggregate(a, _zero(), lambda s, x: s + F.abs(x - m))) / fs)


def finite(v: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(v) < float("inf"), v)
