"""Closed-form location estimators of an array column, as higher-order expressions.

Each takes a non-empty array<double> and a tuning value; all return null where
the estimate isn't defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column, cval: float = 0) -> Column:
    """The sum runs in order of size, so that its last bits don't depend on the order of rows."""
    return total(F.sort_array(a)) / F.size(a)


def median_sorted(s: Column) -> Column:
    n = F.size(s)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return (low + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


def median(a: Column, cval: float = 0) -> Column:
    return let(F.sort_array(a), median_sorted)


def _with_mad(a: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of (median, median absolute deviation)."""
    return let(median(a), lambda m: let(median(F.transform(a, lambda x: F.abs(x - m))), lambda d: body(m, d)))


def trim_mean(a: Column, cval: float) -> Column:
    k = F.floor(F.size(a) * F.lit(float(cval))).cast("int")
    return mean(F.slice(F.sort_array(a), k + 1, F.size(a) - 2 * k))


def winsorize(a: Column, cval: float) -> Column:
    """The lowest k become the next, and the highest k - 1 the k-th highest; k = int(p n) + 1. Null where n <= k."""
    n = F.size(a)
    k = F.floor(n * F.lit(float(cval))).cast("int") + 1
    filled = lambda s: F.transform(s, lambda x, i: F.when(i >= n - k, F.element_at(s, n - k + 1)).when(i < k, F.element_at(s, k + 1)).otherwise(x))
    return F.when(n > k, let(F.sort_array(a), lambda s: mean(filled(s))))


def hampelfilt(a: Column, cval: float) -> Column:
    return _with_mad(a, lambda m, d: mean(F.transform(a, lambda x: F.when(F.abs(x - m) >= d * float(cval), m).otherwise(x))))


def huber_psi(a: Column, cval: float) -> Column:
    c = F.lit(float(cval))
    return _with_mad(a, lambda m, d: F.when(d > 0, m + d * mean(F.transform(a, lambda x: F.greatest(F.least((x - m) / d, c), -c)))))


def tau(a: Column, cval: float) -> Column:
    """Weights (1 - (y / c)^2)^2 are kept where the weight itself is at most c."""
    c = F.lit(float(cval))

    def estimate(m: Column, d: Column) -> Column:
        weight = lambda x: F.pow(1 - F.pow((x - m) / (d * 0.675) / c, F.lit(2.0)), F.lit(2.0))
        pairs = F.filter(F.transform(a, lambda x: F.struct(x.alias("x"), weight(x).alias("w"))), lambda p: F.abs(p["w"]) <= c)
        return let(pairs, lambda p: F.try_divide(total(F.transform(p, lambda q: q["w"] * q["x"])), total(F.transform(p, lambda q: q["w"]))))

    return _with_mad(a, lambda m, d: F.when(d > 0, estimate(m, d)))


def hodges(a: Column, cval: float = 0) -> Column:
    """Median of the means of all pairs, self-pairs included."""
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 1, F.size(a)), lambda y: (x + y) / 2)))
    return median(pairs)


ESTIMATORS = {f.__name__: f for f in (mean, median, trim_mean, winsorize, hampelfilt, huber_psi, tau, hodges)}
