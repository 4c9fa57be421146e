"""Segmentation: a new segment starts where the time step exceeds the tolerance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.operators.cells import in_cells


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


class Isolated:
    """A table whose columns have names of no one else's (c0, c1, ...) while an operator adds its own, and their old names."""

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str | None) -> str | None:
        """The present name of a column; as in Spark, upper and lower case are the same where there is no exact match."""
        if name is None:
            return None
        at = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(at) != 1:
            raise ValueError(f"{'no' if not at else 'more than one'} column {name!r} in {self.names}")
        return f"c{at[0]}"

    def all(self, names: Sequence[str]) -> list[str]:
        return [self.of(n) for n in names]

    def kept(self, replaced: Sequence[str] = ()) -> dict[str, str]:
        """Present and old names of the columns, but for the ``replaced`` (in any case)."""
        lowered = {r.lower() for r in replaced}
        return {f"c{i}": n for i, n in enumerate(self.names) if n.lower() not in lowered}


def restored(kept: dict[str, str]) -> list[Column]:
    return [quoted(c).alias(n) for c, n in kept.items()]


def usable(time: Column, flux: Column | None = None) -> Column:
    """Whether time (times flux) is a number; infinities are numbers, but 0 times infinity isn't."""
    product = time.cast("double") * (flux.cast("double") if flux is not None else F.lit(1.0))
    return product.isNotNull() & ~F.isnan(product)  # isnan of null is false


def segment(df: DataFrame, time: str = "time", flux: str | None = "flux", series: Sequence[str] = (), row_id: str | None = None, break_tolerance: float = 1.0, name: str = "segment_id", chunk: float | None = None) -> DataFrame:
    """``df`` with ``name``: the number, from 0, of each row's segment in its series.

    A segment ends before a step strictly over ``break_tolerance`` (0: one
    segment). Rows whose time or flux is null or NaN don't count and get null.
    Order: time, then ``row_id``. One exchange by the series keys, which all
    later windows over (series, segment) reuse. A null series key is a series.
    ``chunk``: a span of time by which series are dealt out, for those that one
    task can't hold (see ``operators.cells``); the numbers are the same. Columns
    of any name come back as they were, but for one called ``name`` (in any
    case), which is replaced.
    """
    if chunk is not None and not 0 < chunk < math.inf:
        raise ValueError("chunk must be finite and positive")
    own = Isolated(df)
    time, flux, series, row_id = own.of(time), own.of(flux), own.all(series), own.of(row_id)
    ready = own.df.withColumns({"__t": quoted(time).cast("double"), "__ok": usable(quoted(time), quoted(flux) if flux else None)})
    numbered = in_cells(ready, series, row_id, break_tolerance or math.inf, chunk) if chunk else numbered_segments(ready, series, row_id, break_tolerance or math.inf)
    return numbered.select(*restored(own.kept([name])), F.col("__segment").alias(name))


def numbered_segments(df: DataFrame, series: Sequence[str], row_id: str | None, tolerance: float) -> DataFrame:
    """``df`` (with __t, __ok) and __segment. __ok is a column, not an expression in the windows, which would cost an exchange each."""
    if tolerance == math.inf:
        return df.withColumn("__segment", F.when(F.col("__ok"), 0).cast("int"))
    by_time = Window.partitionBy(*[quoted(s) for s in series], "__ok").orderBy("__t", *([quoted(row_id)] if row_id else []))
    starts = F.when(F.col("__t") - F.lag("__t").over(by_time) > tolerance, 1).otherwise(0)
    return df.withColumn("__start", F.when(F.col("__ok"), starts)).withColumn("__segment", F.sum("__start").over(by_time).cast("int")).drop("__start")


def segment_durations(df: DataFrame, time: str = "time", series: Sequence[str] = (), name: str = "segment_id") -> DataFrame:
    """(series..., segment, start, end, duration, n) of a segmented ``df``, one row a segment."""
    t = quoted(time).cast("double")
    return df.filter(quoted(name).isNotNull()).groupBy(*[quoted(s) for s in series], quoted(name)).agg(F.min(t).alias("start"), F.max(t).alias("end"), (F.max(t) - F.min(t)).alias("duration"), F.count("*").alias("n"))
