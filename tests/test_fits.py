"""The FITS source and sink against files of a small encoder of the tests' own."""

import gzip
import math
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException

import sparktrend as st
from sparktrend.sources import fits, fits_format
from sparktrend.sources.fits import read_fits, write_fits


def cards(*pairs):
    out = b""
    for name, value in pairs:
        shown = "T" if value is True else "F" if value is False else f"'{value}'" if isinstance(value, str) else repr(value)
        out += f"{name:<8}= {shown:>20} / a comment".ljust(80).encode("latin-1")
    out += b"COMMENT = 'not a value'".ljust(80) + b"END".ljust(80)
    return out.ljust(-(-len(out) // 2880) * 2880)


def padded(data):
    return data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def binary_table(columns, rows, heap=b"", more=()):
    """``columns``: (name, form); ``rows``: the bytes of each row."""
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(rows[0]) if rows else 8), ("NAXIS2", len(rows)), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (name, form) in enumerate(columns, 1):
        head += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    return cards(*head, *more) + padded(b"".join(rows) + heap)


IMAGE = cards(("XTENSION", "IMAGE"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", 10), ("NAXIS2", 100), ("PCOUNT", 0), ("GCOUNT", 1)) + padded(b"\1" * 4000)


def file_of(*units, **keywords):
    return cards(("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 1), ("NAXIS1", 3), *keywords.items()) + padded(b"\0\1\0\2\0\3") + b"".join(units)


def light_curve(n, first=0, kind="d"):
    """(bytes, times, fluxes) of TIME (double) and PDCSAP_FLUX (float); each seventh flux is 0, each ninth NaN."""
    t = [(first + i) / 48 for i in range(n)]
    f = [0.0 if i % 7 == 3 else math.nan if i % 9 == 4 else 1000 + i % 13 for i in range(n)]
    return binary_table([("TIME", "D"), ("CADENCE", "J"), ("PDCSAP_FLUX", "E")], [struct.pack(">dif", a, i, b) for i, (a, b) in enumerate(zip(t, f, strict=True))], more=[("EXTNAME", "LIGHTCURVE"), ("TICID", 7 + first)]), t, f


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def test_every_element_type(spark, tmp_path):
    columns = [("l", "L"), ("b", "1B"), ("i", "I"), ("j", "J"), ("k", "K"), ("e", "E"), ("d", "D"), ("a", "6A"), ("c", "C"), ("m", "M"), ("x", "11X"), ("arr", "3I"), ("none", "0D"), ("p", "1PE(4)"), ("q", "1QJ(2)"), ("pa", "PA(9)"), ("px", "PX(9)")]
    heap = struct.pack(">3f", 1.5, 2.5, -3.5) + struct.pack(">2i", 7, -8) + b"longtext " + b"\xa0\x80"
    at = {"p": 0, "q": 12, "pa": 20, "px": 29}

    def row(k):
        full = k == 0
        return b"".join([
            (b"T", b"F", b"\0")[k], struct.pack(">B", 200 + k), struct.pack(">h", -5 - k), struct.pack(">i", -70000 * k), struct.pack(">q", 1 << 40 + k), struct.pack(">f", 0.5 + k), struct.pack(">d", -0.1 * k),
            (b"ab\0xyz", b"word  ", b"      ")[k], struct.pack(">2f", 1, -k), struct.pack(">2d", k, 2), b"\xa0\x20", struct.pack(">3h", k, 2, 3),
            struct.pack(">2i", 3 if full else 0, at["p"]), struct.pack(">2q", 2 - k, at["q"] + 4 * k), struct.pack(">2i", 9 if full else 4, at["pa"]), struct.pack(">2i", 9 if full else 3, at["px"]),
        ])

    (tmp_path / "x.fits").write_bytes(file_of(IMAGE, binary_table(columns, [row(0), row(1), row(2)], heap)))
    df = read_fits(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert kinds["l"] == "boolean" and kinds["b"] == "smallint" and kinds["i"] == "smallint" and kinds["arr"] == "array<smallint>" and kinds["c"] == "struct<re:float,im:float>" and kinds["px"] == "array<boolean>"
    a, b, c = df.collect()
    assert (a.l, b.l, c.l) == (True, False, None) and (a.b, b.i, b.j, b.k, a.e, b.d) == (200, -6, -70000, 1 << 41, 0.5, -0.1)
    assert (a.a, b.a, c.a) == ("ab", "word", "") and tuple(b.c) == (1.0, -1.0) and tuple(b.m) == (1.0, 2.0)
    assert a.x == [True, False, True, False, False, False, False, False, False, False, True] and b.arr == [1, 2, 3] and a.none is None
    assert a.p == [1.5, 2.5, -3.5] and b.p == [] and a.q == [7, -8] and b.q == [-8] and c.q == [] and a.pa == "longtext" and b.pa == "long"
    assert a.px == [True, False, True, False, False, False, False, False, True] and b.px == [True, False, True]


def test_scales_nulls_and_unsigned_integers(spark, tmp_path):
    columns = [("byte", "B"), ("u2", "I"), ("u4", "J"), ("u8", "K"), ("scaled", "I"), ("gone", "J")]
    more = [("TZERO1", -128), ("TZERO2", 32768), ("TZERO3", 2147483648), ("TZERO4", 9223372036854775808), ("TSCAL5", 0.5), ("TZERO5", 10), ("TNULL5", -1), ("TNULL6", 99)]
    rows = [struct.pack(">BhiqhI", 0, 0, 0, 0, 4, 99), struct.pack(">BhiqhI", 255, -32768, 2147483647, 9223372036854775807, -1, 5)]
    (tmp_path / "u.fit").write_bytes(file_of(binary_table(columns, rows, more=more)))
    df = read_fits(spark, str(tmp_path / "u.fit"))
    assert [t for _, t in df.dtypes] == ["tinyint", "int", "bigint", "decimal(20,0)", "double", "int"]
    assert [tuple(r) for r in df.collect()] == [(-128, 32768, 2147483648, Decimal(9223372036854775808), 12.0, None), (127, 0, 4294967295, Decimal(18446744073709551615), None, 5)]


def test_files_and_row_ranges_come_back_once(spark, tmp_path, monkeypatch):
    want = []
    for k in range(3):
        unit, t, f = light_curve(1000, k * 1000)
        (tmp_path / f"s{k}.fits").write_bytes(file_of(IMAGE, unit, OBJECT=f"star {k}"))
        want += [(f"star {k}", k * 1000 + 7, i, a, float(np.float32(b))) for i, (a, b) in enumerate(zip(t, f, strict=True))]
    unit, *_ = light_curve(10, 9000)
    (tmp_path / "s3.fits.gz").write_bytes(gzip.compress(file_of(unit, OBJECT="packed")))
    (tmp_path / "notes.txt").write_text("no table")
    df = read_fits(spark, str(tmp_path), "OBJECT string, TICID long, _row long, TIME double, PDCSAP_FLUX double", split_bytes=4000)
    assert df.rdd.getNumPartitions() > 10
    got = sorted(tuple(r) for r in df.collect() if r.OBJECT != "packed")
    assert len(got) == 3000 and all(same(x, y) for g, w in zip(got, sorted(want), strict=True) for x, y in zip(g, w, strict=True))
    assert df.filter("OBJECT = 'packed'").count() == 10
    one = read_fits(spark, str(tmp_path / "s*.fits"), columns="TIME,_file", keywords="object")
    assert one.columns == ["TIME", "_file", "object"] and one.count() == 3000 and one.select("_file").distinct().count() == 3


def test_only_named_columns_are_decoded(spark, tmp_path, monkeypatch):
    unit, *_ = light_curve(50)
    (tmp_path / "s.fits").write_bytes(file_of(unit))
    seen = []
    monkeypatch.setattr(fits_format, "decode", lambda file, table, column, raw, zero=False: seen.append(column.name) or fits_format._numbers(np.ascontiguousarray(raw[:, column.offset : column.offset + column.width]).view(fits_format.NUMPY[column.code]).ravel(), column, zero))
    from pyspark.sql import types as T

    source = fits.FitsReader(str(tmp_path), {}, T.StructType([T.StructField("time", T.DoubleType()), T.StructField("absent", T.StringType())]))
    batches = [b for p in source.partitions() for b in source.read(p)]
    assert seen == ["TIME"] and sum(b.num_rows for b in batches) == 50 and batches[0].column(1).null_count == 50


def test_slabs_are_bounded(tmp_path, monkeypatch):
    from pyspark.sql import types as T

    monkeypatch.setattr(fits, "SLAB", 160)
    unit, t, _ = light_curve(95)
    (tmp_path / "s.fits").write_bytes(file_of(unit))
    source = fits.FitsReader(str(tmp_path), {}, T.StructType([T.StructField("TIME", T.DoubleType())]))
    batches = list(source.read(source.partitions()[0]))
    assert max(b.num_rows for b in batches) == 10 and [x for b in batches for x in b.column(0).to_pylist()] == t


def test_several_tables_a_file(spark, tmp_path):
    first = binary_table([("v", "J")], [struct.pack(">i", k) for k in range(3)], more=[("EXTNAME", "ONE")])
    second = binary_table([("w", "D")], [struct.pack(">d", 1 / (k + 1)) for k in range(4)], more=[("EXTNAME", "Two")])
    (tmp_path / "m.fits").write_bytes(file_of(first, IMAGE, second, binary_table([("z", "D")], [])))
    assert read_fits(spark, str(tmp_path)).columns == ["v"] and read_fits(spark, str(tmp_path), table="2").columns == ["w"]
    assert [r.w for r in read_fits(spark, str(tmp_path), table="two").collect()] == [1, 1 / 2, 1 / 3, 1 / 4]
    assert read_fits(spark, str(tmp_path), "z double", table="3").count() == 0
    with pytest.raises(PySparkException, match="no binary table 4"):
        read_fits(spark, str(tmp_path), table="4").count()


@pytest.mark.parametrize("spoil", [lambda x: x[: len(x) - 3000], lambda x: b"GARBAGE" + x[7:], lambda x: x.replace(b"NAXIS1  =                   16", b"NAXIS1  =                   17"), lambda x: x[:4000]])
def test_spoiled_files_are_named(spark, tmp_path, spoil):
    unit, *_ = light_curve(500)
    (tmp_path / "bad.fits").write_bytes(spoil(file_of(unit)))
    with pytest.raises(PySparkException, match="bad.fits"):
        read_fits(spark, str(tmp_path), "TIME double").count()


def test_no_files(spark, tmp_path):
    with pytest.raises(PySparkException, match="no FITS file"):
        read_fits(spark, str(tmp_path))
    assert read_fits(spark, str(tmp_path), "TIME double").count() == 0


def test_light_curves_feed_flatten_and_zeros_are_missing(spark, tmp_path):
    rows = []
    for k in range(2):
        unit, t, f = light_curve(300, k * 300)
        (tmp_path / f"s{k}.fits").write_bytes(file_of(unit, OBJECT=f"star {k}"))
        rows += [(f"star {k}", i, a, None if b == 0 else float(np.float32(b))) for i, (a, b) in enumerate(zip(t, f, strict=True))]
    read = read_fits(spark, str(tmp_path), "OBJECT string, _row long, TIME double, PDCSAP_FLUX double", zero_as_null="pdcsap_flux")
    assert read.filter("PDCSAP_FLUX IS NULL").count() == sum(r[3] is None for r in rows)
    plain = spark.createDataFrame(rows, "OBJECT string, _row long, TIME double, PDCSAP_FLUX double")
    call = {"time": "TIME", "flux": "PDCSAP_FLUX", "series": ["OBJECT"], "row_id": "_row", "method": "median", "window_length": 0.5}
    found, want = (sorted((r.OBJECT, r._row, r.trend, r.flat) for r in st.flatten(df, **call).collect()) for df in (read, plain))
    assert found == want and sum(r[2] is not None for r in found) > 400


def test_written_tables_come_back(spark, tmp_path):
    rows = [(i, None if i == 3 else i * 0.5, i % 2 == 0 if i != 4 else None, f"né {i}" if i != 5 else None, -i if i != 6 else None) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, v double, yes boolean, name string, small short").repartition(3)
    write_fits(df, str(tmp_path / "out"), file_rows=400, table="EVENTS")
    back = read_fits(spark, str(tmp_path / "out"), table="events")
    assert back.dtypes == df.dtypes
    got = sorted(tuple(r) for r in back.collect())
    assert len(list((tmp_path / "out").iterdir())) >= 7 and not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".fits"]
    for g, w in zip(got, rows, strict=True):  # null doubles are NaN, null texts empty
        assert all(same(a, math.nan if b is None and k == 1 else "" if b is None and k == 3 else b) for k, (a, b) in enumerate(zip(g, w, strict=True)))
    write_fits(df.limit(5), str(tmp_path / "out"), mode="overwrite")
    assert read_fits(spark, str(tmp_path / "out")).count() == 5
    with pytest.raises(PySparkException, match="no column of type"):
        write_fits(spark.createDataFrame([([1],)], "a array<int>"), str(tmp_path / "odd"))
    assert not [p for p in (tmp_path / "odd").rglob("*.fits")]
