"""Lomb-Scargle power by series and frequency.

``engine="sums"`` is one aggregation with partial sums, a row and frequency at a
time: right for few frequencies. ``engine="fft"`` spreads the rows of each
series over a grid of times (``operators.nufft``) and transforms that: right for
many. Tasks make grids of the parts of a series that they hold, which add up, so
no task holds the rows of a series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.operators.nufft import Plan, powers
from sparktrend.operators.segments import Isolated, quoted, usable

#: Numbers of a grid that travel together, the rows of a series beyond which it is dealt out, into how many parts, and the series whose results leave a task together.
BLOCK, LARGE, PARTS, TOGETHER = 4096, 1_000_000, 16, 256


def lomb_scargle(df: DataFrame, omegas: Sequence[float], time: str = "time", flux: str = "flux", series: Sequence[str] = (), engine: str = "sums") -> DataFrame:
    """(series..., omega, power) at each angular frequency of the fixed list ``omegas``; unusable rows don't count.

    ``engine``: "sums" or "fft" (see the module), whose powers agree to about
    1e-10 of the largest. Frequencies are 0 or more for "fft".
    """
    if engine not in ("sums", "fft") or engine == "fft" and min(omegas, default=0) < 0:
        raise ValueError("engine is sums or fft, and fft takes no negative frequencies")
    if engine == "fft":
        return _by_grids(df, [float(w) for w in omegas], time, flux, series)
    t, y = quoted(time).cast("double"), quoted(flux).cast("double")
    rows = df.filter(usable(quoted(time), quoted(flux))).select(*[quoted(s) for s in series], t.alias("__t"), y.alias("__y"), F.explode(F.array(*[F.lit(float(w)) for w in omegas])).alias("omega"))
    waves = rows.withColumns({"__c": F.cos(F.col("omega") * F.col("__t")), "__s": F.sin(F.col("omega") * F.col("__t"))})
    c, s, v = F.col("__c"), F.col("__s"), F.col("__y")
    sums = waves.groupBy(*[quoted(k) for k in series], "omega").agg(F.sum(v * c).alias("yc"), F.sum(v * s).alias("ys"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"))
    phased = sums.withColumn("tau", F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2).withColumns({"ct": F.cos("tau"), "st": F.sin("tau")})
    ct, st, yc, ys, cc, ss, cs = (F.col(k) for k in ("ct", "st", "yc", "ys", "cc", "ss", "cs"))
    along = F.try_divide((ct * yc + st * ys) * (ct * yc + st * ys), ct * ct * cc + 2 * ct * st * cs + st * st * ss)
    across = F.try_divide((ct * ys - st * yc) * (ct * ys - st * yc), ct * ct * ss - 2 * ct * st * cs + st * st * cc)
    return phased.select(*[quoted(k) for k in series], "omega", (0.5 * (along + F.coalesce(across, F.lit(0.0)))).alias("power"))


def _by_grids(df: DataFrame, omegas: list[float], time: str, flux: str, series: Sequence[str]) -> DataFrame:
    own = Isolated(df)
    keys, t, y = own.all(series), quoted(own.of(time)), quoted(own.of(flux))
    name = F.md5(F.to_json(F.struct(*[quoted(k) for k in keys]))) if keys else F.lit("all")
    rows = own.df.filter(usable(t, y)).select(name.alias("id"), *[quoted(k) for k in keys], t.cast("double").alias("t"), y.cast("double").alias("y"))
    spans = rows.groupBy("id", *keys).agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
    # A series may hold most rows: those of many are dealt out, and its row of spans goes to all of its parts. Others stay whole, for one grid each.
    large = F.broadcast(spans.filter(F.col("n") > LARGE).select("id", F.lit(True).alias("large")))
    dealt = rows.select("id", "t", "y", F.monotonically_increasing_id().alias("nth")).join(large, "id", "left").select("id", "t", "y", F.when(F.col("large"), F.pmod("nth", F.lit(PARTS))).otherwise(0).cast("long").alias("part"))
    last = F.when(F.col("n") > LARGE, PARTS - 1).otherwise(0).cast("long")
    parts = spans.select("id", "low", "high", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    asked, top = np.array(omegas), 2 * max(omegas, default=0.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plan, n, values, ones = None, None, 0, None, None

        ready: list[tuple] = []

        def finished() -> None:
            a, b = values.reshape(-1, min(BLOCK, plan.size)), ones.reshape(-1, min(BLOCK, plan.size))
            ready.extend((at, plan.low, plan.high, n, int(i), a[i].tobytes(), b[i].tobytes()) for i in np.flatnonzero(b.any(axis=1) | a.any(axis=1)))

        def blocks() -> pa.RecordBatch:
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*ready, strict=True), kinds, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "low", "high", "n", "block", "a", "b"])

        for batch in batches:
            ids, low, high, held, t, y = (batch.column(k) for k in range(6))
            names, lows, highs, counts, times, fluxes = ids.to_numpy(zero_copy_only=False), *(c.to_numpy() for c in (low, high, held, t, y))
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != at:
                    if plan is not None:
                        finished()
                        if len(ready) >= TOGETHER:
                            yield blocks()
                    at, n, plan = names[a], int(counts[a]), Plan(float(lows[a]), float(highs[a]), top)
                    values, ones = np.zeros(plan.size), np.zeros(plan.size)
                more, more_ones = plan.spread_all(times[a:b], [fluxes[a:b], np.ones(b - a)])
                values += more
                ones += more_ones
        if plan is not None:
            finished()
            if ready:
                yield blocks()

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plan, n, values, ones = None, None, 0, None, None

        ready: list[tuple] = []

        def done() -> pa.RecordBatch:
            ids, found = zip(*ready, strict=True)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.float64()))], names=["id", "powers"])

        for batch in batches:
            for id_, low, high, held, block, a, b in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if id_ != at:
                    if plan is not None:
                        ready.append((at, powers(plan, n, values, ones, asked).tolist()))
                        if len(ready) * len(asked) >= TOGETHER * 32:
                            yield done()
                    at, n, plan = id_, held, Plan(low, high, top)
                    values, ones = np.zeros(plan.size), np.zeros(plan.size)
                where = slice(block * BLOCK, (block + 1) * BLOCK)
                values[where] += np.frombuffer(a)
                ones[where] += np.frombuffer(b)
        if plan is not None:
            ready.append((at, powers(plan, n, values, ones, asked).tolist()))
            yield done()

    joined = dealt.join(parts, ["id", "part"]).select("id", "low", "high", "n", "t", "y").sortWithinPartitions("id")
    grids = joined.mapInArrow(spread, "id string, low double, high double, n long, block int, a binary, b binary")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grids.repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(transformed, "id string, powers array<double>")
    named = spans.select("id", *keys).join(found, "id").select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(w) for w in omegas]).alias("omega"), F.col("powers").alias("power"))).alias("each"))
    return named.select(*[quoted(k).alias(s) for k, s in zip(keys, series, strict=True)], "each.omega", "each.power")
