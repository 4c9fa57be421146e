"""The driver contract, and each SQL-expressible query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparktrend.plans import queries as series

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame, columns):
    shown = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, shown.values.tolist()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(series.oracle_sql()))
def test_matches_sql(spark, name):
    got = series.queries()[name](spark, DATA).toPandas()
    base = duckdb.connect()
    for t in ("events", "orders"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = base.execute(series.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", [n for n in series.queries() if n not in series.oracle_sql()])
def test_runs(spark, name):
    assert series.queries()[name](spark, DATA).count() > 0
