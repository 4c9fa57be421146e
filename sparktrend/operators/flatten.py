"""Trend and detrended value for every row of many series.

Closed-form sliding estimates are Catalyst plans: one range frame per row and
higher-order functions on it. Everything iterative runs as a numpy kernel on
the Arrow batches of a partition sorted by (series, segment, time). Both paths need one exchange, by
the series keys, so a series must fit into a task. With ``chunk`` it needn't:
segmentation and sliders are dealt out by time cells (``operators.cells``), and
the methods that fit a whole segment by segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrend.functions.estimators import ESTIMATORS
from sparktrend.operators import order_stats
from sparktrend.operators.cells import in_cells, with_guests
from sparktrend.operators.kernels import WIDEST, slide_segments, trend_of
from sparktrend.operators.segments import Isolated, numbered_segments, quoted, restored, usable
from sparktrend.plans.params import CLOSED, GLOBAL, Params

ADDED = ("segment_id", "trend", "flat")
#: Rows of a series beyond which ``chunk="auto"`` deals it out.
AUTO_ROWS = 1_000_000
#: Methods whose fits search or iterate, so that they take long for the bytes they read.
SEARCHED = ("gp", "lasso", "elasticnet", "hspline", "lowess", "rspline", "pspline")


def _measured(df: DataFrame, time: str, flux: str, mask: str | None) -> DataFrame:
    """``df`` with __t, __f, __ok, __masked."""
    masked = F.coalesce(quoted(mask).cast("boolean"), F.lit(False)) if mask else F.lit(False)
    return df.withColumns({"__t": quoted(time).cast("double"), "__f": quoted(flux).cast("double"), "__ok": usable(quoted(time), quoted(flux)), "__masked": masked})


def _prepared(df: DataFrame, time: str, flux: str, series: Sequence[str], row_id: str | None, mask: str | None, p: Params, chunk: float | None = None) -> DataFrame:
    """``df`` measured and segmented, by ``in_cells`` if there is a ``chunk``."""
    kept = _measured(df, time, flux, mask)
    return in_cells(kept, series, row_id, p.break_tolerance, chunk) if chunk else numbered_segments(kept, series, row_id, p.break_tolerance)


def _frame(series: Sequence[str], row_id: str | None) -> tuple[str, str]:
    keys = ", ".join([*[f"`{s}`" for s in series], "__ok", "__segment"])
    return f"PARTITION BY {keys}", f"PARTITION BY {keys} ORDER BY __t" + (f", `{row_id}`" if row_id else "")


def _by_expression(df: DataFrame, series: Sequence[str], row_id: str | None, p: Params) -> DataFrame:
    whole, ordered = _frame(series, row_id)
    marked = df.withColumns({"__last": F.expr(f"lead(__t) OVER ({ordered}) IS NULL"), "__low": F.expr(f"min(__t) OVER ({whole})"), "__high": F.expr(f"max(__t) OVER ({whole})")})
    return _estimated(marked, whole, p)


def _estimated(df: DataFrame, whole: str, p: Params) -> DataFrame:
    """``df`` (with __last, __low, __high) and trend. Half-open windows: a closed range frame, then a filter of its list."""
    half = p.window_length / 2
    h = f"{half!r}D"
    signed = F.when(F.col("__masked"), -F.col("__f")).otherwise(F.col("__f"))
    value = F.when(signed > -1e-12, signed) if p.drop_negative else F.when(~F.col("__masked"), F.col("__f"))
    points = F.expr(f"collect_list(CASE WHEN __ok AND NOT __last AND __v IS NOT NULL THEN named_struct('t', __t, 'v', __v) END) OVER ({whole} ORDER BY __t RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)")
    values = F.transform(F.filter("__points", lambda q: q["t"] < F.col("__t") + half), lambda q: q["v"])
    cut = min(p.edge_cutoff, half)
    inner = (F.col("__t") >= F.col("__low") + cut) & (F.col("__t") <= F.col("__high") - cut)
    listed = df.withColumn("__v", value).withColumn("__points", points).withColumn("__values", values)
    trend = F.when(F.col("__ok") & inner & (F.size("__values") > 0), ESTIMATORS[p.method](F.col("__values"), p.cval))
    return listed.withColumn("trend", trend)


def _by_cells(df: DataFrame, row_id: str | None, p: Params, chunk: float, payload: Sequence[str], engine: str, widest: int) -> DataFrame:
    """Sliders over the cells of ``in_cells`` and their guests; other methods over its segments."""
    schema = lambda d: T.StructType([*d.schema.fields, T.StructField("trend", T.DoubleType())])
    if p.method in GLOBAL:
        whole = df.withColumn("__whole", F.lit(0.0))
        if p.method == "supersmoother":
            spans = df.filter("__ok").groupBy("__key").agg((F.max("__t") - F.min("__t")).alias("__whole")).withColumnRenamed("__key", "__k")
            whole = df.join(spans, F.col("__key") == F.col("__k"), "left").drop("__k")
        spare = F.when(~F.col("__ok"), F.col("__cell"))  # rows without a segment are no group
        return whole.groupBy("__key", "__ok", "__segment", spare).applyInArrow(_kernel(p, row_id), schema(whole))
    dealt = with_guests(df, p.window_length / 2, chunk, payload)
    if engine == "expression":
        return _estimated(dealt, "PARTITION BY __key, __ok, __segment, __at", p).filter("__home")
    keys = ["__key", "__ok", "__segment", "__at"]
    order = ["__t", *([quoted(row_id)] if row_id else [])]
    begun = dealt.withColumn("__begins", F.lag("__t").over(Window.partitionBy(*keys).orderBy(*order)).isNull())
    return _streamed(begun.sortWithinPartitions(*keys, *order), p, widest).filter("__home")


def _numbers(table: pa.Table, p: Params, row_id: str | None) -> tuple[np.ndarray, np.ndarray, float]:
    """(order, trend in that order, nsplines) of one group."""
    import pyarrow.compute  # noqa: F401

    t, f = (table.column(c).to_numpy() for c in ("__t", "__f"))
    if row_id:
        ranks = pa.compute.rank(table.column(row_id).combine_chunks(), sort_keys="ascending", tiebreaker="first").to_numpy()
        order = np.lexsort((ranks, t))
    else:
        order = np.argsort(t, kind="stable")
    w = 1.0 - table.column("__masked").to_numpy()[order].astype(float)
    whole = table.column("__whole")[0].as_py() or 0.0
    trend, count = trend_of(t[order].astype(float), f[order].astype(float), w, p, whole)
    return order, trend, count


def _by_kernel(df: DataFrame, series: Sequence[str], row_id: str | None, p: Params, widest: int) -> DataFrame:
    """Kernels on the sorted rows of a partition, as a stream: a task holds a batch and a segment."""
    keys = [*[quoted(s) for s in series], "__ok"]
    order = ["__t", *([quoted(row_id)] if row_id else [])]
    before = F.lag("__segment").over(Window.partitionBy(*keys).orderBy(*order))
    whole = (F.max("__t").over(Window.partitionBy(*keys)) - F.min("__t").over(Window.partitionBy(*keys))) if p.method == "supersmoother" else F.lit(0.0)
    # The first row of a series and all rows without a segment begin one as well.
    begun = df.withColumns({"__whole": whole, "__begins": F.coalesce(before != F.col("__segment"), F.lit(True))})
    return _streamed(begun.sortWithinPartitions(*keys, *order), p, widest)  # as the window leaves them: no further sort


def _streamed(ready: DataFrame, p: Params, widest: int) -> DataFrame:
    """``ready``, whose segments follow each other in its partitions, each from a row that __begins, and trend."""
    parts = "__last" in ready.columns  # of segments, by cells

    def solved(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        t, f, ok, masked, begins = (table.column(c).to_numpy() for c in ("__t", "__f", "__ok", "__masked", "__begins"))
        t, f, w = t.astype(float), f.astype(float), 1.0 - masked.astype(float)
        first = np.flatnonzero(begins)
        segments = [(a, b) for a, b in zip(first, [*first[1:], len(t)], strict=True) if ok[a]]
        if p.method in GLOBAL:
            out, spans = np.full(len(t), np.nan), table.column("__whole").to_numpy()
            for a, b in segments:
                out[a:b] = trend_of(t[a:b], f[a:b], w[a:b], p, spans[a])[0]
        else:
            extents = [(t[a], t[b - 1], b - a - 1) for a, b in segments]
            if parts:
                low, high, last = (table.column(c).to_numpy(zero_copy_only=False) for c in ("__low", "__high", "__last"))
                extents = [(low[a], high[a], b - a - int(last[a:b].sum())) for a, b in segments]
            out = slide_segments(t, f, w, p, [(*s, *e) for s, e in zip(segments, extents, strict=True)], widest)
        yield from table.append_column("trend", pa.array(out, pa.float64(), from_pandas=True)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # an unfinished segment
        for batch in batches:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index("__begins")).to_numpy(zero_copy_only=False))
            if len(first):
                if held or first[-1]:
                    yield from solved([*held, batch.slice(0, first[-1])])
                batch, held = batch.slice(first[-1]), []
            held.append(batch)
        if held:
            yield from solved(held)

    return ready.mapInArrow(run, T.StructType([*ready.schema.fields, T.StructField("trend", T.DoubleType())]))


def _kernel(p: Params, row_id: str | None) -> Callable[[pa.Table], pa.Table]:
    """A group's table -> the same with trend (NaN as null)."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        out = np.full(table.num_rows, np.nan)
        if table.column("__ok")[0].as_py():
            order, trend, _ = _numbers(table, p, row_id)
            out[order] = trend
        return table.append_column("trend", pa.array(out, pa.float64(), from_pandas=True))

    return run


def auto_chunk(df: DataFrame, time: str, series: Sequence[str], least: float, rows: int = AUTO_ROWS) -> float | None:
    """The span of time that holds about ``rows`` rows of the densest series with more rows than that, ``least`` at least; None without such a series. Reads the times once."""
    t = F.nanvl(quoted(time).cast("double"), F.lit(None))
    by_series = df.groupBy(*[quoted(s) for s in series]).agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).alias("span"))
    span = by_series.filter((F.col("n") > rows) & (F.col("span") > 0)).agg(F.min(F.col("span") * rows / F.col("n"))).head()[0]
    return None if span is None else max(span, least)


def window_rows(df: DataFrame, time: str, series: Sequence[str], window: float) -> float:
    """How many rows a window of the densest series holds on average. Reads the times once."""
    t = F.nanvl(quoted(time).cast("double"), F.lit(None))
    by_series = df.groupBy(*[quoted(s) for s in series]).agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).alias("span"))
    return by_series.agg(F.max(F.col("n") * F.least(F.lit(1.0), window / F.greatest("span", F.lit(1e-300))))).head()[0] or 0


def _tasks(df: DataFrame) -> int:
    """Tasks of work that takes long for its bytes: as many as shuffles have, several a core."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def flatten(df: DataFrame, time: str = "time", flux: str = "flux", series: Sequence[str] = (), row_id: str | None = None, mask: str | None = None, engine: str = "auto", chunk: float | str | None = None, **options) -> DataFrame:
    """The columns of ``df``, and segment_id, trend, flat (flux / trend).

    ``series``: key columns; each key is a series of its own, in order of time
    and ``row_id``. ``mask``: a boolean column, true for rows to leave out of
    fits (null: false). ``options``: those of ``Params.resolve`` (method,
    window_length, break_tolerance, edge_cutoff, cval, proportiontocut, kernel,
    kernel_size, kernel_period, kernel_search, robust, max_splines, stdev_cut, drop_negative).
    ``engine``: "expression" (closed-form sliders only), "kernel", "tree"
    (those of ``order_stats.METHODS``: a window costs the same whatever its
    width, with sums to about 1e-12 of the values; "kernel" takes it for windows
    of more than ``WIDEST`` rows), or "auto": expressions where they suit, which
    is for closed-form sliders but hodges. "measured" counts the rows of each
    series first, and takes the tree if a window holds more than ``WIDEST``.
    ``chunk``: a span of time (for sliders, a window or more) by which series
    are dealt out, for those that one task can't hold or that hold a large
    share of all rows. Methods that fit a whole segment still hold one in a
    task. Results are the same; it costs more exchanges. "auto" counts the rows
    of each series first and picks the span in which the densest series over
    ``AUTO_ROWS`` rows has that many, or none if there is no such series.

    Rows with a null or NaN time or flux get nulls. A trend that isn't defined
    (empty window, cut edge, too short a segment, zero spread where the method
    divides by it) is null, as is a zero trend; flat is null with it. Columns
    segment_id, trend, flat of ``df`` are replaced; all others come back as
    they were, whatever their names.
    """
    p = Params.resolve(**options)
    if engine == "measured":
        engine = "tree" if p.method in order_stats.METHODS and window_rows(df, time, series, p.window_length) > WIDEST else "auto"
    if engine == "auto":  # pairs of a window are too many for a list in a row
        engine = "expression" if p.method in CLOSED and p.method != "hodges" else "kernel"
    if engine not in ("expression", "kernel", "tree") or (engine == "tree" and p.method not in order_stats.METHODS) or (engine == "expression" and p.method not in CLOSED):
        raise ValueError(f"engine {engine!r} can't run {p.method}")
    if chunk == "auto":
        chunk = auto_chunk(df, time, series, 1e-9 if p.method in GLOBAL else p.window_length)
    if chunk is not None and not (0 if p.method in GLOBAL else p.window_length) <= chunk < math.inf or chunk == 0:
        raise ValueError("chunk must be finite, and span a window or more")
    widest = 0 if engine == "tree" else WIDEST
    own = Isolated(df)
    series, row_id, names = own.all(series), own.of(row_id), own.kept(ADDED)
    # Adaptive execution merges partitions by their bytes; fits that take long for their bytes would then run in few tasks.
    dealt = own.df.repartition(_tasks(df), *[quoted(s) for s in series]) if p.method in SEARCHED and series and not chunk else own.df
    ready = _prepared(dealt, own.of(time), own.of(flux), series, row_id, own.of(mask), p, chunk)
    if chunk:
        done = _by_cells(ready, row_id, p, chunk, [c for c in names if c != row_id], engine, widest)
    else:
        done = _by_expression(ready, series, row_id, p) if engine == "expression" else _by_kernel(ready, series, row_id, p, widest)
    return _flattened(done, names)


def _flattened(done: DataFrame, kept: dict[str, str]) -> DataFrame:
    """``kept`` under their old names, segment_id, trend and flat of rows with __f and trend."""
    trend = F.when(F.col("trend") != 0, F.nanvl("trend", F.lit(None)))
    divided = done.withColumn("__trend", trend)
    return divided.select(*restored(kept), F.col("__segment").alias("segment_id"), F.col("__trend").alias("trend"), F.try_divide("__f", "__trend").alias("flat"))


def nsplines(df: DataFrame, time: str = "time", flux: str = "flux", series: Sequence[str] = (), row_id: str | None = None, chunk: float | None = None, **options) -> DataFrame:
    """(series..., segment_id, nsplines) of a pspline fit, one row a segment. ``chunk``: as in ``flatten``."""
    p = Params.resolve(**{"method": "pspline", **options})
    own = Isolated(df)
    keys, row_id = own.all(series), own.of(row_id)
    ready = _prepared(own.df, own.of(time), own.of(flux), keys, row_id, None, p, chunk).filter("__ok").withColumn("__whole", F.lit(0.0))
    names = [*keys, "__segment"]

    def run(table: pa.Table) -> pa.Table:
        return table.select(names).slice(0, 1).append_column("nsplines", pa.array([float(_numbers(table, p, row_id)[2])]))

    schema = T.StructType([*[ready.schema[n] for n in names], T.StructField("nsplines", T.DoubleType())])
    import pyarrow.compute  # noqa: F401

    found = ready.groupBy(*[quoted(n) for n in names]).applyInArrow(run, schema)
    return found.select(*[quoted(k).alias(n) for k, n in zip(keys, series, strict=True)], F.col("__segment").alias("segment_id"), "nsplines")
