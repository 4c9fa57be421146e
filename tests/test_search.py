"""Searches of process parameters: the cost of many at once, and tasks enough for what takes long."""

import numpy as np
import pytest

import sparktrend as st
from sparktrend.operators import flatten as module
from sparktrend.operators import kernels as K


@pytest.mark.parametrize(("kernel", "q"), [("squared_exp", [2.0]), ("periodic", [1.0, 7.0, 1.0])])
def test_kept_terms_cost_what_the_whole_does(kernel, q):
    rng = np.random.default_rng(3)
    t, q = np.sort(rng.uniform(0, 30, 60)), np.array(q)
    y = rng.normal(size=60)
    cost = K.Dense(t, y, kernel)
    for k in (None, *range(len(q)), 0):
        tried = np.where(np.arange(len(q)) == k, q * 1.3, q)
        low, weights = K.gp_solve(t, y, kernel, tried)
        assert cost(tried) == pytest.approx(0.5 * y @ weights + np.log(np.diag(low)).sum(), rel=1e-6)


def test_a_search_asks_for_no_parameters_twice(monkeypatch):
    asked, whole = [], K.Dense.__call__
    monkeypatch.setattr(K.Dense, "__call__", lambda self, q: asked.append(tuple(q)) or whole(self, q))
    t = np.linspace(0, 20, 40)
    K.gp_parameters(t, np.sin(t), "periodic", np.array([1.0, 6.0, 1.0]))
    assert 20 < len(asked) == len(set(asked))


def test_searches_run_in_many_tasks(spark):
    df = spark.range(400).selectExpr("id", "id % 40 AS star", "CAST(id DIV 40 AS DOUBLE) AS time", "1 + sin(id) / 100 AS flux")
    out = st.flatten(df, series=["star"], row_id="id", method="gp", kernel="matern", kernel_size=1.0, break_tolerance=0)
    assert out.rdd.getNumPartitions() == module._tasks(df) >= 4 * spark.sparkContext.defaultParallelism
