"""The tree over ranks against brute force."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

import sparktrend as st
from sparktrend.operators import kernels as K
from sparktrend.operators import order_stats
from sparktrend.plans.params import Params

VALUES = hs.lists(hs.one_of(hs.integers(-4, 4).map(float), hs.floats(-1e3, 1e3), hs.just(0.1), hs.just(0.3)), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(VALUES, hs.data())
def test_selection_counts_and_sums(values, data):
    x = np.array(values)
    tree = order_stats.RankTree(x)
    low = data.draw(hs.integers(0, len(x) - 1))
    high = data.draw(hs.integers(low + 1, len(x)))
    own = np.sort(x[low:high])
    a, b = np.full(len(own), low), np.full(len(own), high)
    k = np.arange(len(own))
    assert tree.smallest(a, b, k).tolist() == own.tolist()
    np.testing.assert_allclose(tree.sum_of_smallest(np.append(a, low), np.append(b, high), np.append(k, len(own))) + np.append(k, len(own)) * tree.middle, np.concatenate([[0], np.cumsum(own)]), atol=1e-9)
    ranks = np.arange(len(x) + 1)
    order = np.argsort(np.argsort(x, kind="stable"), kind="stable")
    assert tree.below(np.full(len(ranks), low), np.full(len(ranks), high), ranks).tolist() == [(order[low:high] < r).sum() for r in ranks]


@settings(max_examples=200, deadline=None)
@given(VALUES, hs.sampled_from(order_stats.METHODS), hs.data())
def test_estimates_equal_the_plain_ones(values, method, data):
    x = np.array(values)
    cval = data.draw(hs.sampled_from({"trim_mean": [0.1, 0.25, 0.49, 0.0], "winsorize": [0.1, 0.3, 0.49]}.get(method, [3.0, 1.28, 1.0])))
    p = Params.resolve(method=method, cval=cval)
    spans = [(a, b) for a in range(0, len(x), 3) for b in range(a + 1, len(x) + 1, 2)]
    got = order_stats.estimates(order_stats.RankTree(x), np.array([s[0] for s in spans]), np.array([s[1] for s in spans]), p)
    with np.errstate(all="ignore"):
        want = [K.window_estimator(p)(x[a:b]) for a, b in spans]
    np.testing.assert_allclose(got, want, atol=1e-9, rtol=1e-11)


@pytest.mark.parametrize("method", order_stats.METHODS)
@pytest.mark.parametrize("drop", [True, False])
def test_sliders_with_masks_ties_and_negative_values(method, drop):
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 4000, 900) / 40)
    f = np.round(rng.normal(1, 0.8, 900), 1)
    w = (rng.random(900) > 0.1).astype(float)
    p = Params.resolve(method=method, window_length=9.0, drop_negative=drop, edge_cutoff=1.0)
    parts = [(0, 300, t[0], t[299], 299), (300, 302, t[300], t[301], 1), (302, 900, t[302], t[899], 597)]
    np.testing.assert_allclose(K.slide_segments(t, f, w, p, parts, 0), K.slide_segments(t, f, w, p, parts, 10**9), atol=1e-10)


def test_time_does_not_grow_with_the_width():
    n = 60_000
    t, f, w = np.arange(n) * 1.0, np.random.default_rng(0).normal(size=n), np.ones(n)

    def seconds(window):
        began = time.perf_counter()
        K.slide(t, f, w, Params.resolve(method="median", window_length=window))
        return time.perf_counter() - began

    narrow, broad = seconds(1_000), seconds(30_000)
    assert broad < 3 * narrow + 0.5


def test_empty_windows_and_one_value():
    tree = order_stats.RankTree(np.array([5.0]))
    assert tree.median(np.array([0]), np.array([1])).tolist() == [5.0] and tree.deviation(np.array([0]), np.array([1]), np.array([5.0])).tolist() == [0.0]
    p = Params.resolve(method="median", window_length=2.0)
    masked = K.slide_segments(np.arange(5.0), np.ones(5), np.zeros(5), p, [(0, 5, 0.0, 4.0, 4)], 0)
    assert np.isnan(masked).all()


@pytest.mark.parametrize("method", order_stats.METHODS)
def test_engines_agree(spark, method):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, float(rng.uniform(0, 60)), float(rng.normal(1, 0.3)) if i % 17 else None, bool(i % 11 == 0)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, star int, time double, flux double, masked boolean")
    call = {"series": ["star"], "row_id": "id", "mask": "masked", "method": method, "window_length": 11.0, "break_tolerance": 3.0}
    want = {r["id"]: (r["segment_id"], r["trend"]) for r in st.flatten(df, engine="expression", **call).collect()}
    for more in ({"engine": "tree"}, {"engine": "tree", "chunk": 15.0}, {"engine": "measured"}):
        got = {r["id"]: (r["segment_id"], r["trend"]) for r in st.flatten(df, **more, **call).collect()}
        assert got.keys() == want.keys()
        for k, (segment, trend) in want.items():
            assert got[k][0] == segment and (got[k][1] == pytest.approx(trend, abs=1e-10) if trend is not None else got[k][1] is None), (more, k)


def test_the_tree_engine_is_refused_where_it_can_not_answer(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "time double, flux double")
    for method in ("tau", "hodges", "biweight", "lowess"):
        with pytest.raises(ValueError, match="tree"):
            st.flatten(df, method=method, engine="tree")


def test_measuring_takes_the_tree_for_wide_windows(spark):
    df = spark.createDataFrame([(i, i / 100, 1.0 + i % 7) for i in range(2000)], "id long, time double, flux double")
    out = st.flatten(df, row_id="id", method="median", window_length=6.0, break_tolerance=0, engine="measured")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and out.filter("trend = 4").count() > 1000
