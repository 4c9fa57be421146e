"""Methods, their defaults, and eager validation on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Tuning defaults by method; methods without an entry have 0.
DEFAULT_CVAL = {
    "biweight": 5,
    "andrewsinewave": 1.339,
    "welsch": 2.11,
    "huber": 1.5,
    "huber_psi": 1.28,
    "hampelfilt": 3,
    "tau": 4.5,
    "hampel": (1.7, 3.4, 8.5),
    "ramsay": 0.3,
    "savgol": 2,
    "ridge": 1,
    "lasso": 1,
    "elasticnet": 1,
}
CLOSED = ("median", "mean", "trim_mean", "winsorize", "hampelfilt", "huber_psi", "tau", "hodges")
NEWTON = ("biweight", "andrewsinewave", "welsch")
JOINT = ("huber", "hampel", "ramsay")
GLOBAL = ("lowess", "rspline", "hspline", "pspline", "cosine", "cofiam", "savgol", "medfilt", "gp", "ridge", "lasso", "elasticnet", "supersmoother")
METHODS = (*NEWTON, *CLOSED, *JOINT, *GLOBAL)
KERNELS = (None, "squared_exp", "matern", "periodic", "periodic_auto")


def _positive(name: str, value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < math.inf:
        raise ValueError(f"{name} must be finite and positive")
    return float(value)


@dataclass(frozen=True)
class Params:
    """Resolved parameters of one flatten call; ``Params.resolve`` validates."""

    method: str
    window_length: float
    break_tolerance: float
    edge_cutoff: float
    cval: float | tuple[float, float, float]
    kernel: str
    kernel_size: float
    kernel_period: float
    kernel_search: bool
    robust: bool
    max_splines: int
    stdev_cut: int
    drop_negative: bool

    @staticmethod
    def resolve(method="biweight", window_length=None, break_tolerance=None, edge_cutoff=0, cval=None, proportiontocut=0.1, kernel=None, kernel_size=None, kernel_period=None, kernel_search=True, robust=False, max_splines=50, stdev_cut=2, drop_negative=True) -> Params:
        """Raise ValueError for anything that can't run, else fill in defaults.

        ``proportiontocut`` must be a float strictly between 0 and 0.5 whatever
        the method; an explicit ``cval`` takes its place for the trimming
        methods. A window of None is 2; a break tolerance of None is half the
        window, and 0 turns segmentation off. ``kernel_search``: whether gp looks
        for the likeliest parameters between half and twice those given.
        """
        if method not in METHODS:
            raise ValueError(f"method {method!r} isn't one of {', '.join(METHODS)}")
        if not isinstance(proportiontocut, float) or not 0 < proportiontocut < 0.5:
            raise ValueError(f"proportiontocut is the share that is cut at each end, a float between 0 and 0.5, not {proportiontocut!r}")
        if cval is None:
            cval = proportiontocut if method in ("trim_mean", "winsorize") else DEFAULT_CVAL.get(method, 0)
        if method in ("trim_mean", "winsorize") and not 0 <= cval < 0.5:
            raise ValueError("cval must be in [0, 0.5) for trim_mean and winsorize")
        if method == "hampel" and (not isinstance(cval, (tuple, list)) or len(cval) != 3):
            raise ValueError("hampel takes three numbers as cval")
        window = _positive("window_length", 2 if window_length is None else window_length)
        if method in ("savgol", "medfilt") and window != int(window):
            raise ValueError("window_length counts samples for savgol and medfilt")
        if method == "medfilt" and int(window) % 2 == 0:
            raise ValueError("medfilt needs an odd window_length")
        tolerance = window / 2 if break_tolerance is None else float(break_tolerance)
        if method == "gp":
            if kernel not in KERNELS:
                raise ValueError(f"Unknown kernel {kernel!r}")
            kernel_size = _positive("kernel_size", kernel_size)
            kernel_period = _positive("kernel_period", kernel_period) if kernel == "periodic" else 0.0
        if not isinstance(stdev_cut, int) or stdev_cut < 1:
            raise ValueError("stdev_cut must be a positive integer")
        return Params(method, window, tolerance or math.inf, float(edge_cutoff), tuple(map(float, cval)) if isinstance(cval, (tuple, list)) else float(cval), kernel or "squared_exp", float(kernel_size or 0), float(kernel_period or 0), bool(kernel_search), bool(robust), int(max_splines), stdev_cut, drop_negative)
