"""The periodogram's parts: small series stay whole, large ones are dealt out, with the same powers."""

import numpy as np

import sparktrend as st
from sparktrend.operators import periodogram as P


def test_powers_are_the_same_whole_and_in_parts(spark, monkeypatch):
    df = spark.range(0, 600, 1, 4).selectExpr("id", "id % 3 AS star", "CAST(id DIV 3 AS DOUBLE) / 7 AS time", "1 + sin(id) AS flux")
    omegas = [0.5, 1.0, 2.5]

    def run():
        rows = P.lomb_scargle(df, omegas, series=["star"], engine="fft").collect()
        return np.array([r["power"] for r in sorted(rows)])

    want = np.array([r["power"] for r in sorted(st.lomb_scargle(df, omegas, series=["star"]).collect())])
    np.testing.assert_allclose(run(), want, atol=1e-8 * want.max())
    plan = P.lomb_scargle(df, omegas, series=["star"], engine="fft")._jdf.queryExecution().analyzed().toString()
    assert str(P.LARGE) in plan
    monkeypatch.setattr(P, "LARGE", 100)
    np.testing.assert_allclose(run(), want, atol=1e-8 * want.max())
