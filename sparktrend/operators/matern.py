"""Matérn 3/2 processes in time linear in the points.

The process and its scaled derivative form a Markov chain: from one time to the
next both decay and gain noise by closed forms of the step. A Kalman filter
gives the likelihood, and a backward pass over what it has kept the mean at
every time, as exact as the dense equations. Variances are kept factored, as
that of the value, the derivative's slope on it, and what the value leaves of
the derivative's; all updates are then sums of products without differences.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np

#: Variance of the noise of the values, relative to the process.
NOISE = 1e-10
ROOT3 = math.sqrt(3)


def tail(x: np.ndarray) -> np.ndarray:
    """exp(x) - 1 - x - x^2 / 2 for x >= 0, by its series where the difference would lose digits."""
    near = np.minimum(x, 1.0)
    term = near**3 / 6
    total = term.copy()
    for k in range(4, 20):
        term = term * near / k
        total += term
    with np.errstate(over="ignore"):
        return np.where(x < 1, total, np.expm1(x) - x - x * x / 2)


@dataclass
class Steps:
    """For each time the step to it: the transition's entries and the noise's factors (0 at the first)."""

    a11: np.ndarray
    a12: np.ndarray
    a22: np.ndarray
    q: np.ndarray
    slope: np.ndarray
    rest: np.ndarray
    det: np.ndarray

    @staticmethod
    def of(t: np.ndarray, size: float) -> Steps:
        z = np.minimum(np.diff(t, prepend=t[0]) * (ROOT3 / size), 300.0)  # beyond that nothing is left of the past
        decay, twice = np.exp(-z), np.exp(-2 * z)
        rise = tail(2 * z)
        q11, q12, q22 = twice * rise, 2 * z * z * twice, twice * (4 * z + rise)
        slope = np.divide(q12, q11, out=np.zeros(len(z)), where=q11 > 0)
        return Steps(decay * (1 + z), decay * z, decay * (1 - z), q11, slope, np.maximum(q22 - q12 * slope, 0), twice)


def filtered(t: np.ndarray, y: np.ndarray, size: float, noise: float = NOISE, keep: bool = False) -> tuple[float, list[array]]:
    """(minus the log likelihood up to a constant, and with ``keep`` for each time the predicted value, its variance, the slope on it, the innovation, its variance) of values ``y`` (NaN: none) at sorted times ``t``."""
    s = Steps.of(t, size)
    m, g, p, b, c = 0.0, 0.0, 1.0, 0.0, 1.0  # the stationary state
    cost, logs = 0.0, 0.0
    kept = [array("d") for _ in range(5)]
    for a11, a12, a22, q, k, r, det, value in zip(s.a11.tolist(), s.a12.tolist(), s.a22.tolist(), s.q.tolist(), s.slope.tolist(), s.rest.tolist(), s.det.tolist(), y.tolist(), strict=True):
        m, g = a11 * m + a12 * g, a22 * g - a12 * m
        x1, y1 = a11 + a12 * b, a22 * b - a12
        new = p * x1 * x1 + c * a12 * a12 + q
        both = p * x1 * y1 + c * a12 * a22 + q * k
        minors = p * c * det * det + p * q * (x1 * k - y1) ** 2 + p * r * x1 * x1 + c * q * (a12 * k - a22) ** 2 + c * r * a12 * a12 + q * r
        p, b, c = new, both / new, minors / new
        if value == value:
            total = p + noise
            v = value - m
            cost += v * v / total
            logs += math.log(total)
            if keep:
                for column, number in zip(kept, (m, p, b, v, total), strict=True):
                    column.append(number)
            gain = p / total
            m, g = m + gain * v, g + b * gain * v
            p *= noise / total
        elif keep:
            for column, number in zip(kept, (m, p, b, 0.0, math.inf), strict=True):
                column.append(number)
    return 0.5 * (cost + logs), kept


def smoothed(t: np.ndarray, y: np.ndarray, size: float, noise: float = NOISE) -> np.ndarray:
    """The process's mean at each of the sorted times ``t``, given the values ``y`` (NaN: none) at some of them."""
    if not len(t):
        return np.zeros(0)
    _, kept = filtered(t, y, size, noise, keep=True)
    s = Steps.of(t, size)
    out, r1, r2 = array("d"), 0.0, 0.0
    # What is to come moves the state by its variance times (r1, r2).
    for m, p, b, v, total, a11, a12, a22 in zip(*(reversed(k) for k in kept), *(reversed(a) for a in (s.a11.tolist(), s.a12.tolist(), s.a22.tolist())), strict=True):
        if total < math.inf:
            gain = p / total
            r1 = v / total + (1 - gain) * r1 - b * gain * r2
        out.append(m + p * (r1 + b * r2))
        r1, r2 = a11 * r1 - a12 * r2, a12 * r1 + a22 * r2
    return np.frombuffer(out)[::-1]
