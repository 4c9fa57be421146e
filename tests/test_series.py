"""Detrending operators: published goldens, brute force, properties, edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain
import sparktrend as st
from sparktrend.operators import kernels as K
from sparktrend.plans.params import CLOSED, GLOBAL, METHODS, Params


def synthetic(offset):
    """A sine with planted outliers, and normals number ``offset`` and on of the legacy seed 0."""
    t = np.linspace(0, 30, 1000)
    rng = np.random.RandomState(0)
    rng.normal(0, 1e-4, offset)
    f = 1 + np.sin(t) / 1000 + rng.normal(0, 1e-4, 1000)
    for i in range(0, 1000, 75):
        f[i : i + 5] -= 4e-4
        f[i + 50 : i + 52] += 2e-4
    return t, f


def frame(spark, t, f, **more):
    rows = pd.DataFrame({"row": np.arange(len(t)), "time": t, "flux": f, **more})
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "row long, time double, flux double" + "".join(f", {k} {'boolean' if k == 'mask' else 'string'}" for k in more))


def test_durations(spark):
    row = spark.range(1).select(st.t14(1, 1, 365).alias("a"), st.t14(1, 1, 365, True).alias("b"), st.t14(1, 0, 365).alias("c")).head()
    assert row["a"] == pytest.approx(0.6490025258902046, rel=1e-14)
    assert row["b"] == pytest.approx(0.5403690143737738, rel=1e-14)
    assert row["c"] is None


def test_clip_golden(spark):
    t, f = synthetic(0)
    got = st.slide_clip(frame(spark, t, f), 0.5, low=3, high=2, row_id="row").agg(F.sum("clipped")).head()[0]
    assert got == pytest.approx(948.9926368754939, abs=1e-9)


@pytest.mark.parametrize(("method", "golden", "digits"), [("ridge", 999.9999958887022, 9), ("lasso", 999.9999894829843, 5), ("elasticnet", 999.9999945063338, 5)])
def test_regression_goldens(spark, method, golden, digits):
    t, f = synthetic(1000)
    got = st.flatten(frame(spark, t, f), row_id="row", method=method, window_length=0.5).agg(F.sum("flat")).head()[0]
    assert round(abs(got - golden), digits) == 0


@pytest.mark.parametrize(("method", "cval", "golden"), [("hampel", (2.5, 4.5, 9.5), 999.9992212031945), ("ramsay", 0.3, 999.9970566765148)])
def test_loose_goldens(method, cval, golden):
    t, f = synthetic(1000)
    p = Params.resolve(method=method, cval=cval, window_length=0.5)
    trend, _ = K.trend_of(t, f, np.ones(1000), p, 30.0)
    assert abs(np.nansum(f / trend) - golden) < 0.01


def test_periodic_golden():
    rng = np.random.RandomState(0)
    rng.normal(0, 1e-4, 1000)
    x = np.linspace(0, 30, 200)
    f = 1 + (np.sin(x) + rng.normal(0, 0.1, 200)) / 100
    p = Params.resolve(method="gp", kernel="periodic_auto", kernel_size=1.0, window_length=1000)
    trend, _ = K.trend_of(1.5 * x, f, np.ones(200), p, 45.0)
    assert abs(np.nansum(f / trend) - 200) < 0.1


def brute(t, f, mask, p):
    """Windows by boolean masks, one point at a time."""
    out = np.full(len(t), np.nan)
    slow, cut = p.method in ("huber", "hampel", "ramsay"), min(p.edge_cutoff, p.window_length / 2)
    for i in range(len(t)):
        if not t[0] + cut <= t[i] <= t[-1] - cut:
            continue
        inside = (t >= t[i] - p.window_length / 2) & (t < t[i] + p.window_length / 2)
        inside[-1] = False
        x = f[inside & ~mask] if slow else np.where(mask, -f, f)[inside]
        x = x if slow else x[x > -1e-12]
        if len(x) > slow:
            out[i] = plain.estimate(x.tolist(), p.method, p.cval)
    return out


@pytest.mark.parametrize("engine", ["expression", "kernel"])
@pytest.mark.parametrize("method", CLOSED)
def test_sliders_against_brute_force(spark, method, engine):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 12, 60).round(1))  # with ties
    f = rng.normal(5, 3, 60)
    f[[4, 9, 17]] = [-1, 0, -3]
    mask = rng.random(60) < 0.2
    p = Params.resolve(method=method, window_length=2, edge_cutoff=0.3, break_tolerance=0)
    got = st.flatten(frame(spark, t, f, mask=mask), row_id="row", mask="mask", engine=engine, method=method, window_length=2, edge_cutoff=0.3, break_tolerance=0).orderBy("row").toPandas()
    want = brute(t, f, mask, p)
    want[want == 0] = np.nan
    np.testing.assert_allclose(got["trend"].astype(float), want, rtol=1e-9)


@pytest.mark.parametrize("method", [m for m in METHODS if m in ("biweight", "andrewsinewave", "welsch", "huber", "hampel", "ramsay")])
def test_iterated_sliders_against_brute_force(method):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 12, 90).round(1))
    f = rng.standard_t(2, 90) + 8
    f[30:38] = 4.0  # windows without spread
    f[[5, 50]] = [-1, 0]
    mask = rng.random(90) < 0.2
    p = Params.resolve(method=method, window_length=1.5, edge_cutoff=0.3)
    np.testing.assert_allclose(K.trend_of(t, f, 1.0 - mask, p, 12.0)[0], brute(t, f, mask, p), rtol=1e-9)


@pytest.mark.parametrize("method", [m for m in METHODS if m not in CLOSED])
def test_every_kernel_runs_on_small_and_odd_segments(method):
    more = {"gp": {"kernel_size": 1.0}, "savgol": {"window_length": 5}, "medfilt": {"window_length": 5}}.get(method, {})
    p = Params.resolve(**{"method": method, "window_length": 2, "max_splines": 8, **more})
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 40):
        for f in (rng.normal(10, 1, n), np.full(n, 3.0)):
            trend, _ = K.trend_of(np.arange(n) / 4, f, np.ones(n), p, n / 4)
            assert trend.shape == (n,)
    trend, _ = K.trend_of(np.arange(40) / 4, np.full(40, 3.0), np.ones(40), p, 10.0)
    inner = trend[5:-5]
    if method not in ("rspline", "pspline", "gp"):  # these clip a series without spread to nothing
        assert np.allclose(inner[~np.isnan(inner)], 3.0, atol=1e-3)


def test_kernel_properties():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 20, 200))
    f = 10 + np.sin(t) + rng.normal(0, 0.1, 200)
    ones = np.ones(200)
    run = lambda y=f, **o: K.trend_of(t, y, ones, Params.resolve(**o), 20.0)[0]
    np.testing.assert_allclose(run(method="cosine", window_length=4), run(method="cofiam", window_length=4), rtol=1e-7)
    np.testing.assert_allclose(run(2 * t + 1, method="lowess", window_length=4), 2 * t + 1, rtol=1e-8)
    even = np.arange(200.0)
    p = Params.resolve(method="savgol", window_length=7, cval=2)
    np.testing.assert_allclose(K.trend_of(even, even**2, ones, p, 1.0)[0], even**2, atol=1e-6)
    for method in ("biweight", "welsch", "andrewsinewave", "huber", "hampel", "ramsay", "median", "hspline", "rspline", "pspline", "lowess"):
        assert np.nanmean(np.abs(run(method=method, window_length=2) - 10 - np.sin(t))) < 0.25, method
    assert np.nanmean(np.abs(run(method="supersmoother", window_length=0.7) - 10 - np.sin(t))) < 0.1  # its last pass spans two windows
    q = Params.resolve(method="gp", kernel_size=2.0)
    assert np.abs(K.trend_of(t[::4], 10 + np.sin(t[::4]), ones[::4], q, 20.0)[0] - 10 - np.sin(t[::4])).max() < 0.01


def test_feature_sign_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[:, 1] = x[:, 0] + 1e-3 * rng.normal(size=50)
    y = x @ np.array([1, 0, 0, 2, 0, 0, -1, 0.0]) + rng.normal(0, 0.1, 50)
    h, b, l1 = x.T @ x, x.T @ y, 5.0
    w = K.feature_sign(h, b, l1, np.zeros(8))
    grad = h @ w - b
    assert np.all(np.abs(grad) <= l1 * (1 + 1e-6))
    assert np.allclose(grad[w != 0], -l1 * np.sign(w[w != 0]), rtol=1e-6)


def test_segments_gaps_and_missing(spark):
    t = [0.0, 1.0, 2.0, float("nan"), 5.0, 6.0, None, 8.5, 10.0]
    f = [1.0, 2.0, None, 1.0, 1.0, float("nan"), 1.0, 1.0, 0.0]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(t, f, strict=True))]
    df = spark.createDataFrame(rows, "row long, time double, flux double")
    got = [r["segment_id"] for r in st.segment(df, row_id="row", break_tolerance=4.0).orderBy("row").collect()]
    assert got == [0, 0, None, None, 0, None, None, 0, 0]  # a step equal to the tolerance joins; the missing row widens no gap
    got = [r["segment_id"] for r in st.segment(df, row_id="row", break_tolerance=3.0).orderBy("row").collect()]
    assert got == [0, 0, None, None, 1, None, None, 2, 2]
    out = st.flatten(df, row_id="row", method="mean", window_length=2, break_tolerance=3.0).orderBy("row").collect()
    assert [r["trend"] for r in out] == [1.0, 1.0, None, None, None, None, None, 1.0, None]
    assert out[-1]["flat"] is None
    assert out[0].asDict().keys() == {"row", "time", "flux", "segment_id", "trend", "flat"}


@pytest.mark.parametrize("method", ["median", "tau", "biweight", "huber", "cosine", "supersmoother"])
@pytest.mark.parametrize(("chunk", "tolerance"), [(2.0, 0.9), (5.0, 0), (2.5, 0.4)])
def test_cells_equal_whole_series(spark, method, chunk, tolerance):
    rng = np.random.default_rng(12)
    t = np.sort(np.concatenate([rng.uniform(-7, 12, 150).round(1), [20.0, 20.5, 31.0]]))  # ties, points on borders, gaps of many cells
    f = rng.normal(9, 2, len(t))
    f[[3, 40]] = [-1, 0]
    rows = [(i, k, None if i == 11 else float(a), None if i == 23 else float(b), i % 6 == 0, f"n{i}") for k in ("a", None) for i, (a, b) in enumerate(zip(t, f, strict=True))]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)] + [(999, "one", 1.0, 1.0, False, "n")]
    df = spark.createDataFrame(rows, "row long, k string, time double, flux double, mask boolean, n string")
    options = {"series": ["k"], "row_id": "row", "mask": "mask", "method": method, "window_length": 2, "break_tolerance": tolerance, "edge_cutoff": 0.4}
    whole = st.flatten(df, **options).orderBy("row").toPandas()
    for engine in ("auto", "kernel"):
        dealt = st.flatten(df, chunk=chunk, engine=engine, **options).orderBy("row").toPandas()
        pd.testing.assert_frame_equal(dealt, whole, rtol=1e-9)
    assert whole["trend"].notna().sum() > 100
    assert st.flatten(df.filter("false"), chunk=chunk, **options).count() == 0


@pytest.mark.parametrize("tolerance", [0, 0.3, 1.0])
def test_segments_and_clips_by_cells(spark, tolerance):
    rng = np.random.default_rng(6)
    t = np.sort(np.concatenate([rng.uniform(-4, 9, 120).round(1), [15.0, 15.2, 40.0]]))
    f = rng.normal(0, 1, len(t))
    rows = [(i, k, None if i == 9 else float(a), None if i == 21 else float(b), 5) for k in ("a", "b", None) for i, (a, b) in enumerate(zip(t, f, strict=True))]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "row long, k string, time double, flux double, Clipped int")
    for chunk in (1.5, 4.0):
        for call in (lambda **o: st.segment(df, series=["k"], row_id="row", break_tolerance=tolerance, **o), lambda **o: st.slide_clip(df, 1.5, 1.2, 1.1, series=["k"], row_id="row", **o)):
            pd.testing.assert_frame_equal(call(chunk=chunk).orderBy("row").toPandas(), call().orderBy("row").toPandas())
    assert st.slide_clip(df.filter("false"), 1.0, series=["k"], row_id="row", chunk=2.0).count() == 0


@pytest.mark.parametrize("method", ["biweight", "cosine"])
def test_segments_across_arrow_batches(spark, method):
    rows = spark.range(200).selectExpr("id AS row", "id % 3 AS k", "IF(id % 17 = 0, NULL, id / 3.0D + IF(id > 120, 50, 0)) AS time", "2 + sin(id) AS flux")
    run = lambda: st.flatten(rows, series=["k"], row_id="row", method=method, window_length=5, break_tolerance=3).orderBy("row").toPandas()
    whole, key = run(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for n in (1, 7):
            spark.conf.set(key, str(n))
            pd.testing.assert_frame_equal(run(), whole)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("method", ["median", "biweight", "lowess"])
def test_one_exchange(spark, method):
    rows = spark.range(40).selectExpr("id AS row", "id % 4 AS k", "id / 3.0D AS time", "1.0D AS flux")
    plan = st.flatten(rows, series=["k"], row_id="row", method=method, window_length=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    plan = st.slide_clip(rows, 2.0, series=["k"], row_id="row")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_cells_validation(spark):
    df = frame(spark, np.arange(3.0), np.ones(3))
    for bad in ({"chunk": 1.0}, {"chunk": math.inf}, {"chunk": 0, "method": "cosine"}):
        with pytest.raises(ValueError):
            st.flatten(df, row_id="row", window_length=2, **bad)


def test_chunks_follow_the_counts(spark, monkeypatch):
    from sparktrend.operators import flatten as module

    rows = spark.range(3000).selectExpr("id AS row", "IF(id % 10 = 0, 'b', 'a') AS k", "IF(id % 97 = 0, NULL, id / 100.0D) AS time", "2 + sin(id) AS flux")
    assert module.auto_chunk(rows, "time", ["k"], 0.5) is None
    span = module.auto_chunk(rows, "time", ["k"], 0.5, rows=900)
    assert span == pytest.approx(30 * 900 / 2700, rel=0.05) and module.auto_chunk(rows, "time", ["k"], 50.0, rows=900) == 50.0
    assert module.auto_chunk(rows.filter("false"), "time", ["k"], 0.5, rows=1) is None
    run = lambda chunk: st.flatten(rows, series=["k"], row_id="row", method="median", window_length=2, chunk=chunk).orderBy("row").toPandas()
    whole = run("auto")
    monkeypatch.setattr(module.auto_chunk, "__defaults__", (900,))
    pd.testing.assert_frame_equal(run("auto"), whole)


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "row long, time double, flux double")
    for method in ("median", "biweight", "cosine"):
        assert st.flatten(empty, row_id="row", method=method).count() == 0
    assert st.slide_clip(empty, 1.0, row_id="row").count() == 0
    df = spark.createDataFrame([(i, float(i), 1.0 + i, "x", 7) for i in range(5)], "row long, time double, flux double, trend string, Segment_ID int")
    for method in ("median", "biweight"):
        out = st.flatten(df, row_id="row", method=method, window_length=3)
        assert out.columns == ["row", "time", "flux", "segment_id", "trend", "flat"]
        assert out.count() == 5


def test_mask_expression(spark):
    df = spark.createDataFrame([(0.0,), (0.6,), (-9.7,), (None,), (float("nan"),)], "t double")
    assert [r[0] for r in df.select(st.transit_mask(F.col("t"), 10.0, 1.0, 0.0)).collect()] == [True, False, True, False, False]


def test_clip_against_a_direct_loop(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 10, 80))
    f = rng.normal(0, 1, 80)
    f[5] = np.nan
    df = frame(spark, t, f)
    for compat in (True, False):
        got = st.slide_clip(df, 1.5, low=1.2, high=1.0, row_id="row", compat=compat).orderBy("row").toPandas()["clipped"].astype(float).to_numpy()
        want = np.full(80, np.nan)
        for i in range(79):
            if t[0] < t[i] < t[-1]:
                j = np.flatnonzero((t >= t[i] - 0.75) & (t < t[i] + 0.75) & (np.arange(80) < 79))
                x = f[j]
                filled = np.nan_to_num(x)
                mid = np.nanmean(x) if compat else np.nanmedian(x)
                cut = filled.std() if compat else np.median(np.abs(filled - mid))
                want[j] = np.where((filled - mid > 1.0 * cut) | (filled - mid < -1.2 * cut), np.nan, filled)
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_validation():
    for bad in ({"method": "none"}, {"proportiontocut": 1}, {"proportiontocut": 0.5}, {"method": "gp"}, {"method": "gp", "kernel_size": 1, "kernel": "x"}, {"method": "gp", "kernel_size": 1, "kernel": "periodic"}, {"window_length": 0}, {"method": "medfilt", "window_length": 4}, {"method": "hampel", "cval": 3}, {"stdev_cut": 1.5}):
        with pytest.raises(ValueError):
            Params.resolve(**bad)
    assert Params.resolve(method="median").window_length == 2
    assert Params.resolve(break_tolerance=0).break_tolerance == math.inf
    assert set(GLOBAL) <= set(METHODS) and len(METHODS) == 27


def test_nsplines(spark):
    t, f = synthetic(0)
    rows = st.nsplines(frame(spark, t, f), row_id="row", window_length=2, max_splines=20).collect()
    assert st.nsplines(frame(spark, t, f), row_id="row", chunk=3.0, window_length=2, max_splines=20).collect() == rows
    assert len(rows) == 1 and 2 <= rows[0]["nsplines"] <= 20


def test_stream_equals_batch(spark, tmp_path):
    from sparktrend.streaming.flatten import flatten_stream

    rows = [("a", f"2024-01-01 {h:02d}:00:00", float(1 + h % 3)) for h in range(12)] + [("a", "2024-01-03 00:00:00", 1.0), ("a", "2024-01-05 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "k string, s string, f double").select("k", F.to_timestamp("s").alias("ts"), "f")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = flatten_stream(stream, "ts", "f", ["k"], method="median", window_length=0.25, break_tolerance=0.2)
    query = out.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("closed").filter("start = '2024-01-01'").orderBy("time").toPandas()
    batch = st.flatten(df.withColumn("time", F.unix_micros("ts") / F.lit(86400e6)), flux="f", series=["k"], method="median", window_length=0.25, break_tolerance=0.2).orderBy("time").limit(12).toPandas()
    np.testing.assert_allclose(got["trend"].astype(float), batch["trend"].astype(float))


def test_columns_of_any_name_come_back(spark):
    """Names that the operators use themselves, as payload and as keys."""
    names = ["__t", "__f", "__ok", "__segment", "__v", "__points", "__key", "__cell", "__home", "__whole", "__trend", "__last", "c0", "c1", "values"]
    rows = [(i, float(i) / 3, 2.0 + i % 4, *[f"keep{i}{n}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, "row long, Time double, flux double, " + ", ".join(f"`{n}` string" for n in names))
    keyed = df.withColumn("__start", F.col("row") % 2)
    for out in (
        st.flatten(df, row_id="row", method="median", window_length=2), st.flatten(df, row_id="row", method="biweight", window_length=2, chunk=4.0), st.flatten(df, row_id="row", method="cosine", window_length=2, chunk=4.0),
        st.flatten(keyed, series=["__start"], row_id="row", method="lowess", window_length=2), st.segment(df, row_id="row"), st.segment(df, row_id="row", chunk=2.0), st.slide_clip(df, 1.5, row_id="row"), st.slide_clip(df, 1.5, row_id="row", chunk=4.0),
    ):
        assert [tuple(r[n] for n in ["row", "Time", "flux", *names]) for r in out.orderBy("row").collect()] == rows
    assert st.nsplines(keyed, series=["__start"], row_id="row", window_length=2, max_splines=5).columns == ["__start", "segment_id", "nsplines"]
    with pytest.raises(ValueError):
        st.flatten(df, row_id="none")


def test_splines_against_their_recursion():
    knots, x = np.array([0] * 4 + [0.3, 0.6] + [1] * 4, float), np.linspace(0, 1, 23)
    want, y = plain.design(x, knots), np.sin(5 * x)
    got = K.bspline(x, knots)
    np.testing.assert_allclose(got @ np.arange(6.0), want @ np.arange(6.0))
    for w in (None, np.linspace(1, 2, 23)):
        gram, right = got.moments(y, w)
        held = want * (1 if w is None else w[:, None])
        np.testing.assert_allclose(gram, held.T @ want, atol=1e-12)
        np.testing.assert_allclose(right, held.T @ y, atol=1e-12)


@pytest.mark.parametrize("count", [6, 15, 50])
def test_penalised_splines_against_a_direct_solution(count):
    rng = np.random.default_rng(count)
    x = np.sort(rng.uniform(0, 10, 60))
    y = 5 + np.sin(x) + rng.normal(0, 0.1, 60)
    want, edof = plain.penalised_spline(x.tolist(), y, count)
    curve, got = K.penalized(x, y, count)
    np.testing.assert_allclose(curve(x), want, rtol=1e-6)
    assert got == pytest.approx(edof, rel=1e-6)


def test_huber_splines_minimise_their_loss():
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, 80))
    y = 3 + np.sin(x) + rng.standard_t(1.5, 80) * 0.1
    knots = np.array([0] * 4 + [3.0, 6.0] + [10] * 4, float)
    z = plain.design(x, knots)
    coef, bias = K.huber_regression(K.bspline(x, knots), y)
    beta = np.append(coef, bias)
    least = plain.huber_loss(beta, z, y)
    for k in range(len(beta)):
        for step in (-1e-3, 1e-3):
            assert plain.huber_loss(beta + step * (np.arange(len(beta)) == k), z, y) >= least - 1e-9
    for _ in range(50):
        assert plain.huber_loss(beta + rng.normal(0, 0.01, len(beta)), z, y) > least


@pytest.mark.parametrize(("kernel", "start"), [("squared_exp", [1.5]), ("matern", [2.0]), ("periodic", [1.0, 5.0, 3.0])])
def test_gp_parameters_are_the_likeliest(kernel, start):
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 15, 30))
    y = np.sin(2 * np.pi * x / 6) + rng.normal(0, 0.3, 30)
    q = K.gp_parameters(x, y, kernel, np.array(start))
    least = plain.gp_cost(x, y, kernel, q)
    assert least == pytest.approx(0.5 * y @ K.gp_solve(x, y, kernel, q)[1] + np.log(np.diag(K.gp_solve(x, y, kernel, q)[0])).sum(), rel=1e-6)
    for k in range(len(start)):
        assert start[k] / 2 * (1 - 1e-9) <= q[k] <= start[k] * 2 * (1 + 1e-9)
        for e in (-0.02, -0.005, 0.005, 0.02):
            moved = q.copy()
            moved[k] = np.clip(q[k] * 2**e, start[k] / 2, start[k] * 2)
            assert plain.gp_cost(x, y, kernel, moved) >= least - 1e-6
    if len(start) == 1:
        assert least <= min(plain.gp_cost(x, y, kernel, [start[0] * 2**e]) for e in np.linspace(-1, 1, 81)) + 1e-6
    mean = [sum(plain.gp_kernel(a, b, kernel, q) * w for b, w in zip(x, K.gp_solve(x, y, kernel, q)[1], strict=True)) for a in (0.5, 7.7)]
    np.testing.assert_allclose(K.gp_fit(x, y, kernel, np.array(start))(np.array([0.5, 7.7])), mean, rtol=1e-8)


def test_hodges_of_wide_windows(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 121):
        x = np.sort(rng.integers(0, 9, n) / 4 if n % 2 else rng.normal(size=n))
        want = plain.estimate(x.tolist(), "hodges", 0)
        assert K.hodges_of(x) == pytest.approx(want, abs=1e-12)
        assert K.hodges_rows(np.array([np.append(x, np.nan)])) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(K, "PAIRS", 10)
    assert K.hodges_rows(np.array([np.append(x, np.nan)])) == pytest.approx(want, abs=1e-12)


def test_lowess_by_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 20, 300))
    f = 10 + np.sin(t) + rng.standard_t(2, 300) * 0.1
    run = lambda: K.trend_of(t, f, np.ones(300), Params.resolve(method="lowess", window_length=3), 20.0)[0]
    whole = run()
    monkeypatch.setattr(K, "BLOCK", 50)
    np.testing.assert_allclose(run(), whole, rtol=1e-12)


def test_hand_computed_weights():
    """Three values: mean 4, deviations 3, 2, 5 from it, scale 3 / 0.6745; with these weights the next mean follows by hand."""
    x = np.array([[1.0, 2.0, 9.0]])
    s = 3 / 0.6744897501960817
    weights = np.exp(-0.3 * np.array([3, 2, 5]) / s)
    first = (weights * x[0]).sum() / weights.sum()
    mean, seen = 4.0, []
    K.reweighted_rows(x, lambda z: seen.append(np.abs(z)) or np.exp(-0.3 * np.abs(z)))
    np.testing.assert_allclose(seen[0][0], np.abs(x[0] - mean) / s)
    np.testing.assert_allclose(seen[1][0] * np.median(np.abs(x[0] - first)) / 0.6744897501960817, np.abs(x[0] - first))


def test_sigma_clip(spark):
    rows = [(i, k, v) for k in ("a", None) for i, v in enumerate([1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 1.0, 1.1, 0.9, 5.0, 1.6, -3.0, None, float("nan")])]
    df = spark.createDataFrame(rows, "row long, k string, flat double").withColumn("__x", F.lit("own")).withColumn("Clipped", F.lit(1))
    out = st.sigma_clip(df, series=["k"], lower=4, upper=2).orderBy("k", "row").collect()
    got = [r["clipped"] for r in out[:14]]
    x = [v for _, k, v in rows if k == "a"][:12]
    keep = list(x)
    for _ in range(5):
        held = [v for v in keep if v is not None]
        m, d = np.median(held), np.std(held)
        keep = [v if v is not None and -4 * d <= v - m <= 2 * d else None for v in keep]
    assert got == [*keep, None, None] and got[9] is None and out[0]["__x"] == "own" and out[0].asDict().keys() == {"row", "k", "flat", "__x", "clipped"}
    assert st.sigma_clip(df.filter("false"), series=["k"]).count() == 0
    with pytest.raises(ValueError):
        st.sigma_clip(df, upper=0)
