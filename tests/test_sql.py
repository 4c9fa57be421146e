"""Table functions against the DataFrame calls."""

import datetime

import pytest

import sparktrend as st
from sparktrend.functions.sql import register_sql


@pytest.fixture
def stars(spark):
    rows = []
    for k in range(4):
        for i in range(90):
            t = i / 10 + (3 if i > 40 else 0)
            rows.append((None if k == 3 else k, "ab"[k % 2], None if i == 5 else float("nan") if i == 6 else t, None if i == 7 else 1 + (i * (k + 3) % 11) / 50, i % 13 == 0, i + 100 * k, datetime.date(2020, 1, 1 + i % 28), [i, k], "own"))
    df = spark.createDataFrame(rows, "`the star` int, band string, time double, flux double, masked boolean, id int, day date, pair array<int>, TREND string").repartition(3)
    df.createOrReplaceTempView("stars")
    register_sql(spark)
    return df


def as_set(df, names):
    return sorted((tuple(str(round(r[n], 9)) if isinstance(r[n], float) else str(r[n]) for n in names) for r in df.collect()))


@pytest.mark.parametrize(("sql", "options"), [
    ("method => 'median', window_length => 1.5D, break_tolerance => 1.0D", {"method": "median", "window_length": 1.5, "break_tolerance": 1.0}),
    ("method => 'biweight', mask => 'masked', window_length => 2.5", {"method": "biweight", "mask": "masked", "window_length": 2.5}),
    ("method => 'cosine', break_tolerance => 0", {"method": "cosine", "break_tolerance": 0}),
    ("method => 'supersmoother'", {"method": "supersmoother"}),
    ("method => 'hampel', cval => array(1.7D, 3.4D, 8.5D)", {"method": "hampel", "cval": (1.7, 3.4, 8.5)}),
])
def test_one_text_equals_the_call(spark, stars, sql, options):
    found = spark.sql(f"SELECT * FROM trend_flatten(TABLE(stars), series => 'the star,band', row_id => 'id', {sql})")
    want = st.flatten(stars, series=["the star", "band"], row_id="id", **options)
    assert found.columns == want.columns and [t for _, t in found.dtypes] == [t for _, t in want.dtypes]
    assert as_set(found, found.columns) == as_set(want, want.columns) and found.filter("trend IS NOT NULL").count() > 200


def test_the_calls_own_partitioning(spark, stars):
    found = spark.sql("SELECT id, trend FROM trend_flatten(TABLE(stars) PARTITION BY (`the star`, band) ORDER BY (time, id), method => 'median')")
    want = st.flatten(stars, series=["the star", "band"], row_id="id", method="median").select("id", "trend")
    assert as_set(found, found.columns) == as_set(want, want.columns)


def test_nsplines(spark, stars):
    found = spark.sql("SELECT * FROM trend_nsplines(TABLE(stars), series => 'the star,band', row_id => 'id', window_length => 3, max_splines => 8)")
    want = st.nsplines(stars, series=["the star", "band"], row_id="id", window_length=3, max_splines=8)
    assert found.columns == want.columns and as_set(found, found.columns) == as_set(want, want.columns)


@pytest.mark.parametrize("wrong", ["series => 'none'", "series => 'id', method => 'none'", "series => 'id', colour => 1", "series => 'id', time => 'nothing'"])
def test_wrong_calls_are_refused(spark, stars, wrong):
    with pytest.raises(Exception, match="none|colour|nothing"):
        spark.sql(f"SELECT * FROM trend_flatten(TABLE(stars), {wrong})").collect()


def test_an_empty_table(spark, stars):
    assert spark.sql("SELECT * FROM trend_flatten(TABLE(SELECT * FROM stars WHERE false), series => 'band')").count() == 0
