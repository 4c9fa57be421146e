"""Periodograms by transforms of grids against direct sums."""

import time

import numpy as np
import pytest

import sparktrend as st
from sparktrend.operators import kernels, nufft, periodogram


def made(seed, n, span=80.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n)) + 1e4
    return t, np.sin(t * rng.uniform(0.5, 4)) + rng.normal(0, 0.3, n)


def test_sums_at_any_frequency():
    t, y = made(0, 300)
    omega = np.concatenate([[0.0], np.sort(np.random.default_rng(1).uniform(0, 20, 200))])
    plan = nufft.Plan(t[0], t[-1], 20.0)
    want = np.exp(1j * omega[:, None] * (t - (t[0] + t[-1]) / 2)) @ y
    assert np.abs(plan.sums(plan.spread(t, y), omega) - want).max() < 1e-10 * np.abs(y).sum()


def test_the_peak_is_that_of_the_direct_sums_on_100_series():
    for seed in range(100):
        t, y = made(seed, 20 + 7 * seed)
        omega = np.geomspace(1 / (t[-1] - t[0]), 1 / np.median(np.diff(t)), 2000)
        direct, fast = kernels.power(t - t[0], y, omega), nufft.power(t, y, omega)
        assert np.argmax(direct) == np.argmax(fast) and np.abs(direct - fast).max() < 1e-9 * direct.max()


def test_grids_of_parts_add_up():
    t, y = made(3, 500)
    plan = nufft.Plan(t[0], t[-1], 10.0)
    parts = sum(plan.spread(t[k::7], y[k::7]) for k in range(7))
    np.testing.assert_allclose(parts, plan.spread(t, y), atol=1e-12)


def test_one_and_two_points_and_equal_times():
    assert np.isfinite(nufft.power(np.array([1.0, 2.0]), np.array([1.0, -1.0]), np.array([0.5, 1.0]))).all()
    assert len(nufft.power(np.array([5.0]), np.array([2.0]), np.array([1.0]))) == 1
    assert np.isnan(nufft.power(np.zeros(0), np.zeros(0), np.array([1.0]))).all()
    same = nufft.power(np.full(4, 3.0), np.arange(4.0), np.array([1.0]))
    np.testing.assert_allclose(same, kernels.power(np.zeros(4), np.arange(4.0), np.array([1.0])))


def test_a_million_points_at_ten_thousand_frequencies():
    t, y = np.sort(np.random.default_rng(0).uniform(0, 20_000, 1_000_000)), None
    y = np.sin(1.3 * t)
    omega = np.geomspace(1 / 20_000, 1 / np.median(np.diff(t)), 10_000)
    began = time.perf_counter()
    found = nufft.power(t, y, omega)
    assert abs(omega[np.argmax(found)] - 1.3) < 2e-3 and time.perf_counter() - began < 20


@pytest.mark.parametrize("parts", [1, 16])
def test_engines_agree(spark, monkeypatch, parts):
    monkeypatch.setattr(periodogram, "PARTS", parts)
    monkeypatch.setattr(periodogram, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else k, "x", float(t), float(v) if i % 9 else None) for k in range(5) for i, (t, v) in enumerate(zip(rng.uniform(0, 50, 40 + 20 * k), rng.normal(size=40 + 20 * k), strict=True))]
    rows += [(7, "y", 1.0, 2.0), (8, "y", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, low string, n double, part double")
    call = {"omegas": [0.5, 1.0, 2.5, 0.0], "time": "n", "flux": "part", "series": ["id", "low"]}
    want, got = ({(r["id"], r["low"], r["omega"]): r["power"] for r in st.lomb_scargle(df, engine=e, **call).collect()} for e in ("sums", "fft"))
    assert want.keys() == got.keys() and len(got) == 24
    for key, value in want.items():
        if key[2] and key[0] != 7:
            assert got[key] == pytest.approx(value, abs=1e-8)


def test_engines_are_named(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "time double, flux double")
    for wrong in ({"engine": "x"}, {"engine": "fft", "omegas": [-1.0]}):
        with pytest.raises(ValueError, match="engine"):
            st.lomb_scargle(df, **{"omegas": [1.0], **wrong})
