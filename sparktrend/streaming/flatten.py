"""Detrending a stream: segments are detrended once the watermark has passed them.

An extra beyond the batch operators. A session window whose gap is the break
tolerance is the segment; Structured Streaming closes it when the watermark
passes its last event by the gap, and its rows are then detrended by the batch
kernels.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.operators.kernels import trend_of
from sparktrend.operators.segments import quoted
from sparktrend.plans.params import Params


def flatten_stream(stream: DataFrame, timestamp: str, flux: str, series: Sequence[str], delay: str = "1 hour", **options) -> DataFrame:
    """(series..., start, time, flux, trend, flat) of each closed segment, for append mode.

    Times are days from the segment's start. Late rows beyond ``delay`` are
    dropped by the watermark. Steps equal to the tolerance don't break.
    """
    p = Params.resolve(**options)
    gap = f"{int(p.break_tolerance * 86400e6)} microseconds"
    window = F.session_window(F.col(timestamp), gap)
    point = F.struct(F.unix_micros(F.col(timestamp)).alias("t"), quoted(flux).cast("double").alias("f"))
    kept = stream.withWatermark(timestamp, delay).filter(quoted(flux).isNotNull() & ~F.isnan(quoted(flux).cast("double")))
    closed = kept.groupBy(*[quoted(s) for s in series], window.alias("w")).agg(F.sort_array(F.collect_list(point)).alias("points"))

    @F.pandas_udf("array<double>")
    def trends(points: pd.Series) -> pd.Series:
        def one(rows):
            t = np.array([r["t"] for r in rows], float)
            t = (t - t[0]) / 86400e6
            return trend_of(t, np.array([r["f"] for r in rows]), np.ones(len(t)), p, float(t[-1]))[0]

        return points.map(one)

    rows = closed.withColumn("trend", trends("points")).select(*[quoted(s) for s in series], F.col("w.start").alias("start"), F.explode(F.arrays_zip("points", "trend")).alias("r"))
    trend = F.when(F.col("r.trend") != 0, F.nanvl(F.col("r.trend"), F.lit(None)))
    days = (F.col("r.points.t") - F.unix_micros("start")) / F.lit(86400e6)
    out = rows.select(*[quoted(s) for s in series], "start", days.alias("time"), F.col("r.points.f").alias("flux"), trend.alias("trend"))
    return out.withColumn("flat", F.try_divide("flux", "trend"))
