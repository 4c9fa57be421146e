"""Scalar expressions: event duration, event mask, and row validity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SI constants.
G = 6.67384e-11
R_SUN = 695508000.0
R_JUP = 69911000.0
M_SUN = 1.989e30
SECONDS_PER_DAY = 86400.0


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def t14(r_s: Column | float, m_s: Column | float, p: Column | float, small_planet: bool = False) -> Column:
    """Duration in days of a central transit of a circular orbit of period ``p`` days, for a star of solar radii ``r_s`` and masses ``m_s``.

    The planet has 2 Jupiter radii, or none for ``small_planet``. Null inputs or a zero mass give null.
    """
    r_s, m_s, p = (_column(x) for x in (r_s, m_s, p))
    planet = 0.0 if small_planet else 2 * R_JUP
    cubed = F.try_divide(4 * p * SECONDS_PER_DAY, math.pi * G * M_SUN * m_s)
    return (R_SUN * r_s + planet) * F.pow(cubed, F.lit(1 / 3)) / SECONDS_PER_DAY


def transit_mask(time: Column, period: float, duration: float, t0: float) -> Column:
    """True within ``duration`` / 2 of t0 plus a multiple of ``period``; false for null or NaN times."""
    half = 0.5 * period
    phase = F.abs(F.pmod(time - t0 + half, F.lit(float(period))) - half)
    return F.coalesce((phase < 0.5 * duration) & ~F.isnan(phase), F.lit(False))


def valid(*columns: Column) -> Column:
    """All columns non-null, not NaN and below +infinity (-infinity passes)."""
    out = F.lit(True)
    for c in columns:
        d = c.cast("double")
        out = out & d.isNotNull() & ~F.isnan(d) & (d < float("inf"))
    return out


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` in which all ``columns`` are valid numbers."""
    return df.filter(valid(*[F.col(f"`{c}`") for c in columns]))
