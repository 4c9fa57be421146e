"""Sliding outlier clipping in two window passes, as one Catalyst plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.functions.estimators import let, mean, median
from sparktrend.operators.cells import in_cells, with_guests
from sparktrend.operators.segments import Isolated, quoted, restored


def slide_clip(df: DataFrame, window_length: float, low: float = 3, high: float = 3, method: str | None = None, center: str | None = None, time: str = "time", flux: str = "flux", series: Sequence[str] = (), row_id: str | None = None, compat: bool = True, name: str = "clipped", chunk: float | None = None) -> DataFrame:
    """``df`` with ``name``: flux, or null where it lies beyond ``low`` / ``high`` cutoffs below / above the window's middle.

    Each point is judged by the last eligible window [t - h, t + h) that holds
    it: that of a centre strictly inside the series. The last point, and points
    that no window holds, are null. Missing flux counts as 0 in the cutoff and
    comes out as 0 unless that is clipped. ``compat``: mode names are compared
    as the original does, crosswise, so that the defaults are standard
    deviations from the mean; otherwise method "mad" (default) or "std" and
    center "median" (default) or "mean" mean what they say. ``chunk``: a span
    of time, a window or more, by which series are dealt out, for those that
    one task can't hold; results are the same. Other columns come back as they
    were, whatever their names; one called ``name`` is replaced.
    """
    if not window_length > 0:
        raise ValueError("window_length must be positive")
    method, center = method or "mad", center or "median"
    if method not in ("mad", "std", "median") or center not in ("median", "mean", "mad"):
        raise ValueError("unknown method or center")
    use_median, use_mad = (center == "mad", method == "median") if compat else (center == "median", method == "mad")
    half = window_length / 2
    own = Isolated(df)
    time, flux, series, row_id, kept = own.of(time), own.of(flux), own.all(series), own.of(row_id), own.kept([name])
    t = quoted(time).cast("double")
    f = F.nanvl(quoted(flux).cast("double"), F.lit(None))
    base = own.df.withColumns({"__t": t, "__f": f, "__ok": t.isNotNull() & ~F.isnan(t)}).select(*[quoted(c) for c in kept], "__t", "__f", "__ok")
    if chunk is not None:
        if not window_length <= chunk < math.inf:
            raise ValueError("chunk must span a window or more")
        # A point's judge is up to half a window away, and what that one sees as far again.
        marked = with_guests(in_cells(base, series, row_id, math.inf, chunk), window_length, chunk, [c for c in kept if c != row_id])
        whole = "PARTITION BY __key, __ok, __at"
    else:
        whole = "PARTITION BY " + ", ".join([*[f"`{s}`" for s in series], "__ok"])
        ordered = f"{whole} ORDER BY __t" + (f", `{row_id}`" if row_id else "")
        marked = base.withColumns({"__last": F.expr(f"lead(__t) OVER ({ordered}) IS NULL"), "__low": F.expr(f"min(__t) OVER ({whole})"), "__high": F.expr(f"max(__t) OVER ({whole})"), "__home": F.lit(True)})
    frame = f"{whole} ORDER BY __t RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING"
    held = marked.withColumn("__points", F.expr(f"collect_list(CASE WHEN NOT __last THEN named_struct('t', __t, 'v', __f) END) OVER ({frame})"))
    values = F.transform(F.filter("__points", lambda p: p["t"] < F.col("__t") + half), lambda p: p["v"])

    def judged(v):
        known, filled = F.filter(v, lambda x: x.isNotNull()), F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))
        middle = F.when(F.size(known) > 0, median(known) if use_median else mean(known))
        spread = (lambda m: median(F.transform(filled, lambda x: F.abs(x - m)))) if use_mad else (lambda m: let(mean(filled), lambda c: F.sqrt(mean(F.transform(filled, lambda x: (x - c) * (x - c))))))
        return let(middle, lambda m: F.struct(m.alias("m"), spread(m).alias("c")))

    eligible = F.col("__ok") & ~F.col("__last") & (F.col("__t") > F.col("__low")) & (F.col("__t") < F.col("__high"))
    centred = held.withColumn("__values", values).withColumn("__rule", F.when(eligible & (F.size("__values") > 0), F.struct("__t", let(F.col("__values"), judged).alias("r"))))
    ruled = centred.withColumn("__by", F.expr(f"last(__rule, true) OVER ({frame})"))
    x, m, c = F.coalesce("__f", F.lit(0.0)), F.col("__by.r.m"), F.col("__by.r.c")
    covered = F.col("__by").isNotNull() & ~F.col("__last") & (F.col("__t") < F.col("__by.__t") + half)
    beyond = F.coalesce((x - m > c * float(high)) | (x - m < c * -float(low)), F.lit(False))
    return ruled.filter("__home").withColumn("__clipped", F.when(covered & ~beyond, x)).select(*restored(kept), F.col("__clipped").alias(name))


def sigma_clip(df: DataFrame, flux: str = "flat", series: Sequence[str] = (), lower: float = 20, upper: float = 3, rounds: int = 5, name: str = "clipped") -> DataFrame:
    """``df`` with ``name``: flux, or null where it lies more than ``lower`` / ``upper`` standard deviations below / above its series' median.

    Meant for detrended values. Each round leaves out what the rounds before
    it clipped; rounds that clip nothing change nothing. The deviation is that
    of the population. Null and NaN flux is null and doesn't count; a series
    without values stays null, and one without spread is kept. One exchange by
    the series keys. Other columns come back as they were; one called ``name``
    (in any case) is replaced.
    """
    if not (lower > 0 and upper > 0 and rounds >= 0):
        raise ValueError("lower and upper must be positive, and rounds not negative")
    own = Isolated(df)
    whole, kept = Window.partitionBy(*[quoted(k) for k in own.all(series)]), own.kept([name])
    out = own.df.withColumn("__x", F.nanvl(quoted(own.of(flux)).cast("double"), F.lit(None)))
    for _ in range(rounds):
        stats = out.withColumns({"__m": F.percentile("__x", F.lit(0.5)).over(whole), "__d": F.stddev_pop("__x").over(whole)})
        away = F.col("__x") - F.col("__m")
        out = stats.withColumn("__x", F.when((away <= float(upper) * F.col("__d")) & (away >= -float(lower) * F.col("__d")), F.col("__x"))).drop("__m", "__d")
    return out.select(*restored(kept), F.col("__x").alias(name))
