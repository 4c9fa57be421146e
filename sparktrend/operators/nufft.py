"""Trigonometric sums at any frequencies in O(n + m log m): sum of c_j exp(i w t_j).

Values are spread over a grid of times by a narrow kernel, a fast Fourier
transform gives the sums at evenly spaced frequencies, and the same kernel takes
them to the frequencies asked for; the kernel's transform undoes both. Grids of
parts of a series add up to that of the whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Grid points that the kernel covers, how much finer than needed grids are, and the kernel's shape: errors of about 1e-11 of the sum of |c|.
WIDTH, FINER, SHAPE = 13, 2.0, 2.3 * 13


def kernel(z: np.ndarray) -> np.ndarray:
    """Of places within -1 and 1."""
    return np.exp(SHAPE * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))


@cache
def _transform() -> np.polynomial.Chebyshev:
    """The kernel's Fourier transform up to where it is asked for."""
    node, weight = np.polynomial.legendre.leggauss(80)
    most = np.pi * WIDTH / 2 / FINER * 1.001
    return np.polynomial.Chebyshev.interpolate(lambda x: (weight * kernel(node) * np.cos(x[:, None] * node)).sum(axis=1), 40, [0, most])


def transform(x: np.ndarray) -> np.ndarray:
    return WIDTH / 2 * _transform()(np.abs(x))


def _around(place: np.ndarray):
    """(grid points, kernel) for each of the points that the kernel covers around ``place``, in units of the grid."""
    first = np.ceil(place - WIDTH / 2).astype(np.int64)
    for k in range(WIDTH):
        at = first + k
        yield at, kernel((at - place) * (2 / WIDTH))


@dataclass(frozen=True)
class Plan:
    """Grids for times between ``low`` and ``high`` and frequencies up to ``top``."""

    low: float
    high: float
    top: float

    @property
    def step(self) -> float:
        """Between the evenly spaced frequencies."""
        return np.pi / (FINER * max((self.high - self.low) / 2, 1e-300))

    @property
    def last(self) -> int:
        return int(np.ceil(self.top / self.step)) + WIDTH

    @property
    def size(self) -> int:
        return 1 << int(np.ceil(np.log2(2 * FINER * (self.last + 1))))

    def spread(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The grid of values ``c`` at times ``t``; grids of several parts may be added."""
        return self.spread_all(t, [c])[0]

    def spread_all(self, t: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
        """The grids of several columns of values at times ``t``."""
        angle = (t - (self.low + self.high) / 2) * self.step
        undone, place = 1 / transform(angle * (WIDTH / 2)), angle * (self.size / (2 * np.pi))
        if len(t) < 10_000:  # few rows: one count for all of the kernel's points
            at, weight = (np.concatenate(v) for v in zip(*((at % self.size, weight * undone) for at, weight in _around(place)), strict=True))
            return [np.bincount(at, np.tile(c, WIDTH) * weight, self.size) for c in columns]
        grids = [np.zeros(self.size) for _ in columns]
        for at, weight in _around(place):
            for grid, c in zip(grids, columns, strict=True):
                grid += np.bincount(at % self.size, c * undone * weight, self.size)
        return grids

    def sums(self, grid: np.ndarray, omega: np.ndarray) -> np.ndarray:
        """The sums at the frequencies ``omega``, for times from the middle of the plan."""
        k = np.arange(self.last + 1)
        even = np.conj(np.fft.rfft(grid)[: self.last + 1]) / transform(np.pi * WIDTH * k / self.size)
        both = np.concatenate([np.conj(even[WIDTH:0:-1]), even])  # from -WIDTH on
        out = np.zeros(len(omega), complex)
        for at, weight in _around(omega / self.step):
            out += both[at + WIDTH] * weight
        return out


def powers(plan: Plan, n: int, values: np.ndarray, ones: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Lomb-Scargle power at ``omega`` from the grids of the values and of ones, for n points."""
    y, double = plan.sums(values, omega), plan.sums(ones, 2 * omega)
    cc, ss, cs = (n + double.real) / 2, (n - double.real) / 2, double.imag / 2
    tau = np.arctan2(2 * cs, cc - ss) / 2
    ct, st = np.cos(tau), np.sin(tau)
    cos2, sin2 = ct**2 * cc + 2 * ct * st * cs + st**2 * ss, ct**2 * ss - 2 * ct * st * cs + st**2 * cc
    with np.errstate(divide="ignore", invalid="ignore"):
        sine = np.where(sin2 > 1e-9 * n, (ct * y.imag - st * y.real) ** 2 / sin2, 0.0)
        return 0.5 * ((ct * y.real + st * y.imag) ** 2 / cos2 + sine)


def power(t: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Lomb-Scargle power of one series at angular frequencies of 0 or more."""
    if not len(t) or not len(omega):
        return np.full(len(omega), np.nan)
    plan = Plan(float(t.min()), float(t.max()), 2 * float(np.max(omega)))
    return powers(plan, len(t), *plan.spread_all(t, [y, np.ones(len(t))]), omega)
