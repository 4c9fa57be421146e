"""Estimates and fits in plain Python, straight from their definitions: what kernels are tested against."""

import math
from statistics import fmean, median

import numpy as np


def mad(x, m):
    return median([abs(v - m) for v in x])


def newton(x, c, weight):
    """Weighted steps from the median, with the median absolute deviation as scale, until a step is at most 1e-6."""
    m = median(x)
    s = mad(x, m)
    if s == 0:
        return m
    for _ in range(200):
        w = [weight((v - m) / (c * s)) for v in x]
        if not sum(w):
            return math.nan
        step = sum(a * (v - m) for a, v in zip(w, x, strict=True)) / sum(w)
        m += step
        if abs(step) <= 1e-6:
            break
    return m


WEIGHTS = {
    "biweight": lambda u: (1 - u * u) ** 2 if abs(u) < 1 else 0.0,
    "welsch": lambda u: math.exp(-u * u / 2) if abs(u) < 1 else 0.0,
    "andrewsinewave": lambda u: (math.sin(u) / u if u else 1.0) if abs(u) < math.pi else 0.0,
}


def reweighted(x, weight):
    m, last = fmean(x), None
    for _ in range(50):
        s = median([abs(v - m) for v in x]) / 0.6744897501960817
        if s == 0:
            return m
        w = [weight(abs(v - m) / s) for v in x]
        if not sum(w):
            return m
        m = sum(a * v for a, v in zip(w, x, strict=True)) / sum(w)
        if last is not None and abs(m - last) < 1e-8:
            return m
        last = m
    return m


def hampel_weight(z, a, b, c):
    return 1.0 if z <= a else a / z if z <= b else a * (c - z) / ((c - b) * z) if z <= c else 0.0


def proposal2(x, c):
    n, m = len(x), median(x)
    s = mad(x, m) / 0.6744897501960817
    inside = math.erf(c / math.sqrt(2))
    gamma = inside + c * c * (1 - inside) - 2 * c * math.exp(-c * c / 2) / math.sqrt(2 * math.pi)
    for _ in range(1000):
        if not s > 0:
            break
        new = fmean([min(max(v, m - c * s), m + c * s) for v in x])
        near = [v for v in x if abs((v - m) / s) <= c]
        below = (n - 1) * gamma - (n - len(near)) * c * c
        if below <= 0:
            break
        scale = math.sqrt(sum((v - new) ** 2 for v in near) / below)
        if abs(s - scale) <= scale * 1e-6 and abs(m - new) <= scale * 1e-6:
            return new
        m, s = new, scale
    return median(x)


def estimate(x, method, c):
    """One window's estimate; NaN where it isn't defined."""
    x, n, m = sorted(x), len(x), median(x)
    s = mad(x, m)
    if method in WEIGHTS:
        return newton(x, c, WEIGHTS[method])
    if method == "huber":
        return proposal2(x, c)
    if method == "hampel":
        return reweighted(x, lambda z: hampel_weight(z, *c))
    if method == "ramsay":
        return reweighted(x, lambda z: math.exp(-c * z))
    if method == "hodges":
        return median([(x[i] + x[j]) / 2 for i in range(n) for j in range(i, n)])
    if method == "median":
        return m
    if method == "mean":
        return fmean(x)
    if method == "trim_mean":
        k = int(n * c)
        return fmean(x[k : n - k])
    if method == "winsorize":
        k = int(c * n) + 1
        return fmean([x[k]] * k + x[k : n - k] + [x[n - k]] * k) if 2 * k <= n else fmean([x[n - k] if i >= n - k else x[k] if i < k else v for i, v in enumerate(x)]) if n > k else math.nan
    if method == "hampelfilt":
        return fmean([m if abs(v - m) >= c * s else v for v in x])
    if s == 0:
        return math.nan
    if method == "huber_psi":
        return m + s * fmean([min(max((v - m) / s, -c), c) for v in x])
    w = [(1 - ((v - m) / (0.675 * s) / c) ** 2) ** 2 for v in x]
    w = [a if abs(a) <= c else 0.0 for a in w]
    return sum(a * v for a, v in zip(w, x, strict=True)) / sum(w) if sum(w) else math.nan


def spline_value(x, knots, i, degree=3):
    """The i-th B-spline by its recursion; the last piece closes at its end."""
    if degree == 0:
        return float(knots[i] <= x < knots[i + 1] or (x == knots[-1] and knots[i] < knots[i + 1] == knots[-1]))
    out = 0.0
    for a, b, j in ((knots[i], knots[i + degree], i), (knots[i + degree + 1], knots[i + 1], i + 1)):
        if b != a:
            out += (x - a) / (b - a) * spline_value(x, knots, j, degree - 1)
    return out


def design(x, knots):
    return np.array([[spline_value(v, knots, i) for i in range(len(knots) - 4)] for v in x])


def penalised_spline(x, y, count):
    """(trend at x, effective degrees of freedom): each penalty weight solved by itself, the best by generalised cross-validation."""
    step = (x[-1] - x[0]) / max(count - 3, 1)
    b = design(x, [x[0] + step * k for k in range(-3, count + 1)])
    d = np.diff(np.eye(count), 2, axis=0)
    best = None
    for lam in np.logspace(-3, 3, 11):
        hat = b @ np.linalg.solve(b.T @ b + lam * d.T @ d + 1e-9 * np.eye(count), b.T)
        edof = np.trace(hat)
        score = len(x) * ((y - hat @ y) ** 2).sum() / max(len(x) - 1.4 * edof, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, hat @ y, edof)
    return best[1:]


def huber_loss(beta, z, y, epsilon=1.35, alpha=1e-4):
    """The objective of Huber regression, at the scale that is best for these coefficients (the last one is the intercept)."""
    r = np.abs(y - z @ beta[:-1] - beta[-1])

    def at(s):
        u = r / s
        return (s + s * np.where(u <= epsilon, u**2, 2 * epsilon * u - epsilon**2)).sum() + alpha * (beta[:-1] ** 2).sum()

    low, high = math.log(1e-12), math.log(r.max() + 1e-12) + 2
    for _ in range(200):
        a, b = low + (high - low) * 0.381966, low + (high - low) * 0.618034
        low, high = (low, b) if at(math.exp(a)) < at(math.exp(b)) else (a, high)
    return at(math.exp(low))


def gp_kernel(a, b, kernel, q):
    d = abs(a - b)
    if kernel == "squared_exp":
        return math.exp(-d * d / (2 * q[0] ** 2))
    if kernel == "matern":
        return (1 + math.sqrt(3) * d / q[0]) * math.exp(-math.sqrt(3) * d / q[0])
    return math.exp(-2 * math.sin(math.pi * d / q[1]) ** 2 / q[0] ** 2) + math.exp(-d * d / (2 * q[2] ** 2))


def gp_cost(x, y, kernel, q):
    """The negative log likelihood of a Gaussian process, but for a constant."""
    k = np.array([[gp_kernel(a, b, kernel, q) for b in x] for a in x]) + 1e-10 * np.eye(len(x))
    sign, logdet = np.linalg.slogdet(k)
    return 0.5 * y @ np.linalg.solve(k, y) + logdet / 2 if sign > 0 else math.inf
