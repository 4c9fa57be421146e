"""Gaussian processes in linear time and of low rank, against the dense equations."""

import tracemalloc

import numpy as np
import pytest

import sparktrend as st
from sparktrend.operators import kernels as K
from sparktrend.operators import matern
from sparktrend.plans.params import Params


def series(seed, n, span, ties=True):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    if ties and n > 12:
        t[10] = t[11]
    return t, np.sin(t) / 100 + rng.normal(0, 1e-3, n)


def dense(t, y, z, kernel, q, noise):
    k = K.covariance(t, t, kernel, q) + noise * np.eye(len(t))
    weights = np.linalg.solve(k, y)
    return K.covariance(z, t, kernel, q) @ weights, 0.5 * y @ weights + 0.5 * np.linalg.slogdet(k)[1]


@pytest.mark.parametrize("n", [1, 2, 3, 60, 500])
@pytest.mark.parametrize("size", [0.05, 1.0, 50.0])
def test_the_filter_equals_the_dense_equations(n, size):
    t, y = series(n, n, 30)
    z = np.sort(np.concatenate([np.random.default_rng(1).uniform(-3, 35, 80), t[:3]]))
    every = np.concatenate([t, z])
    order = np.argsort(every, kind="stable")
    for noise in (1e-3, 1e-5):
        want, cost = dense(t, y, every, "matern", np.array([size]), noise)
        got = np.empty(len(every))
        got[order] = matern.smoothed(every[order], np.concatenate([y, np.full(len(z), np.nan)])[order], size, noise)
        np.testing.assert_allclose(got, want, rtol=0, atol=1e-8 * max(y.std(), 0.01))
        assert matern.filtered(t, y, size, noise)[0] == pytest.approx(cost, rel=1e-9, abs=1e-9)


def test_the_filter_is_nearer_the_exact_solution_than_the_dense_one():
    """In extended precision, at the noise that gp uses, where the dense equations lose most digits."""
    long = np.longdouble
    t, y = series(0, 300, 30)
    k = K.covariance(t.astype(long), t.astype(long), "matern", np.array([2000], long)) + long(10) ** -10 * np.eye(300, dtype=long)
    low = np.zeros_like(k)
    for j in range(300):
        low[j, j] = np.sqrt(k[j, j] - low[j, :j] @ low[j, :j])
        low[j + 1 :, j] = (k[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
    u, w = np.zeros(300, long), np.zeros(300, long)
    for i in range(300):
        u[i] = (y[i] - low[i, :i] @ u[:i]) / low[i, i]
    for i in range(299, -1, -1):
        w[i] = (u[i] - low[i + 1 :, i] @ w[i + 1 :]) / low[i, i]
    exact = (y - long(10) ** -10 * w).astype(float)
    filtered = np.abs(matern.smoothed(t, y, 2000.0) - exact).max()
    assert filtered <= 1e-6 * y.std() and filtered <= np.abs(K.covariance(t, t, "matern", np.array([2000.0])) @ K.gp_solve(t, y, "matern", np.array([2000.0]))[1] - exact).max()


def test_empty_and_missing_values():
    assert len(matern.smoothed(np.zeros(0), np.zeros(0), 1.0)) == 0
    np.testing.assert_array_equal(matern.smoothed(np.arange(4.0), np.full(4, np.nan), 1.0), 0)
    far = matern.smoothed(np.array([0.0, 1e9]), np.array([1.0, np.nan]), 1.0)
    assert far[0] == pytest.approx(1, abs=1e-9) and abs(far[1]) < 1e-100


def test_very_many_points_in_bounded_memory():
    n = 200_000
    t = np.arange(n) * 0.02
    y = np.sin(t) / 100
    tracemalloc.start()
    got = matern.smoothed(t, y, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got - y).max() < 1e-4 and peak < 700 * n  # bytes a point; a dense matrix has 8 n


def test_the_likelihood_search_finds_the_least_cost():
    t, y = series(3, 150, 20)
    q = K.gp_parameters(t, y, "matern", np.array([4.0]))
    assert K.gp_cost(t, y, "matern", q) <= min(K.gp_cost(t, y, "matern", np.array([4 * 2**e])) for e in np.linspace(-1, 1, 41)) + 1e-6


@pytest.mark.parametrize(("kernel", "q"), [("squared_exp", [2.0]), ("squared_exp", [0.3]), ("periodic", [1.0, 7.0, 1.0]), ("periodic", [0.5, 3.0, 5.0])])
def test_a_low_rank_factor_is_the_covariance_and_solves_like_it(kernel, q):
    q, (t, y) = np.array(q), series(5, 400, 30)
    z = np.sort(np.random.default_rng(2).uniform(0, 30, 90))
    every = np.concatenate([t, z])
    factor = K.low_rank(every, kernel, q)
    assert factor.shape[1] < 390 and np.abs(factor @ factor.T - K.covariance(every, every, kernel, q)).max() < 1e-12
    low, weights = K.gp_solve(t, y, kernel, q)
    want = K.covariance(every, t, kernel, q) @ weights
    cost, rank_weights = K.low_rank_solve(factor[:400], y)
    # Both lose digits at a noise of 1e-10: measured in extended precision, the dense equations up to 1.5e-4 of the spread on such data.
    np.testing.assert_allclose((factor @ rank_weights)[:400], want[:400], rtol=0, atol=5e-4 * y.std())
    np.testing.assert_allclose(factor @ rank_weights, want, rtol=0, atol=2e-3 * y.std())
    assert cost == pytest.approx(0.5 * y @ weights + np.log(np.diag(low)).sum(), rel=1e-4)


def test_many_points_take_the_low_rank_path_in_bounded_memory(monkeypatch):
    t, y = series(6, 20_000, 60)
    tracemalloc.start()
    out = K.gp(t, y + 1, np.ones(len(t)), Params.resolve(method="gp", kernel="squared_exp", kernel_size=2.0, kernel_search=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and np.abs(out - 1 - np.sin(t) / 100).max() < 2e-3


def test_both_paths_agree(monkeypatch):
    t, y = series(7, 300, 30)
    w = (np.arange(300) % 7 > 0).astype(float)
    p = Params.resolve(method="gp", kernel="squared_exp", kernel_size=2.0, robust=True)
    one = K.gp(t, y + 1, w, p)
    monkeypatch.setattr(K, "DENSE", 10)
    np.testing.assert_allclose(K.gp(t, y + 1, w, p), one, rtol=0, atol=2e-4)


def test_fixed_parameters_through_flatten(spark):
    t, y = series(8, 80, 20, ties=False)
    df = spark.createDataFrame([(i, float(a), float(b) + 1) for i, (a, b) in enumerate(zip(t, y, strict=True))], "id long, time double, flux double")
    out = {r["id"]: r["trend"] for r in st.flatten(df, row_id="id", method="gp", kernel="matern", kernel_size=0.5, kernel_search=False, break_tolerance=0).collect()}
    p = Params.resolve(method="gp", kernel="matern", kernel_size=0.5, kernel_search=False)
    np.testing.assert_allclose([out[i] for i in range(80)], K.gp(t, y + 1, np.ones(80), p), rtol=1e-12)
