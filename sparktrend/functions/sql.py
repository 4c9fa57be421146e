"""Table functions for SQL: ``trend_flatten`` and ``trend_nsplines``.

    SELECT * FROM trend_flatten(TABLE(SELECT * FROM stars), series => 'star', method => 'median', window_length => 0.5D)

The table comes first; ``time``, ``flux``, ``mask`` and ``row_id`` name its columns
('time', 'flux' and none by default), ``series`` its keys, comma-separated;
everything else is an option of ``Params.resolve``. Without ``series`` the call's
own PARTITION BY and ORDER BY (time first) count. Columns of any name and type
come back as they were, those called segment_id, trend or flat replaced.

Rows stream: a segment's results leave when the next one begins, so a task holds
a segment (for supersmoother, whose span is the series', a series).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from sparktrend.operators.kernels import slide_segments, trend_of
from sparktrend.plans.params import GLOBAL, Params

ADDED = ("segment_id", "trend", "flat")
NAMES = ("series", "time", "flux", "mask", "row_id")


@dataclass
class Plan(AnalyzeResult):
    """What the workers need of a call: places of the columns, parameters, and the fields that come back."""

    params: Params | None = None
    at: dict = field(default_factory=dict)
    kept: list = field(default_factory=list)


def planned(table: AnalyzeArgument, options: dict[str, AnalyzeArgument], kind: str) -> Plan:
    """Raise ValueError for unknown columns and options."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    values = {k.lower(): v.value for k, v in options.items()}
    columns, fields = {n: values.pop(n, {"time": "time", "flux": "flux"}.get(n)) for n in NAMES}, table.dataType.fields
    if "cval" in values and isinstance(values["cval"], (list, tuple)):
        values["cval"] = tuple(values["cval"])
    if unknown := set(values) - set(Params.resolve.__code__.co_varnames):
        raise ValueError(f"no option {min(unknown)!r}")
    if kind == "nsplines":
        values = {"method": "pspline", **values}
    plain = {k: float(v) if hasattr(v, "as_tuple") else v for k, v in values.items() if v is not None}

    def place(name: str) -> int:
        found = [i for i, f in enumerate(fields) if f.name == name] or [i for i, f in enumerate(fields) if f.name.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{'no' if not found else 'more than one'} column {name!r}")
        return found[0]

    series = [place(s.strip()) for s in (columns["series"] or "").split(",") if s.strip()]
    at = {n: place(columns[n]) for n in ("time", "flux", "mask", "row_id") if columns[n]}
    at["series"] = series
    kept = [i for i, f in enumerate(fields) if f.name.lower() not in ADDED] if kind == "flatten" else series
    new = [T.StructField("segment_id", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in (("trend", "flat") if kind == "flatten" else ("nsplines",)))]
    quoted = lambda i: "`" + fields[i].name.replace("`", "``") + "`"
    order = [OrderingColumn(quoted(at[n]), ascending=True) for n in ("time", "row_id") if n in at]
    return Plan(
        T.StructType([*(fields[i] for i in kept), *new]), withSinglePartition=not series and bool(columns["series"] == ""),
        partitionBy=[PartitioningColumn(quoted(i)) for i in series], orderBy=order if series else [], params=Params.resolve(**plain), at=at, kept=kept,
    )


class _Segments:
    """Rows of one partition in order of time; ``finished`` makes the results of each segment."""

    def __init__(self, plan: Plan):
        self.plan, self.p = plan, plan.params
        self.rows: list[Row] = []
        self.t: list[float] = []
        self.f: list[float] = []
        self.w: list[float] = []
        self.segment, self.done = 0, []  # done: finished segments that wait for the series' end

    def taken(self, row: Row) -> Iterator[tuple]:
        at = self.plan.at
        time, flux = row[at["time"]], row[at["flux"]]
        t, f = (float("nan") if v is None else float(v) for v in (time, flux))
        if math.isnan(t * f):
            yield from self.unusable(row)
            return
        if self.t and t - self.t[-1] > self.p.break_tolerance:
            yield from self.closed()
            self.segment += 1
        self.rows.append(row)
        self.t.append(t)
        self.f.append(f)
        self.w.append(0.0 if "mask" in at and row[at["mask"]] else 1.0)

    def closed(self) -> Iterator[tuple]:
        held = (self.segment, self.rows, np.array(self.t), np.array(self.f), np.array(self.w))
        self.rows, self.t, self.f, self.w = [], [], [], []
        if self.p.method == "supersmoother":
            self.done.append(held)
        elif held[1]:
            yield from self.finished(*held, 0.0)

    def ended(self) -> Iterator[tuple]:
        yield from self.closed()
        whole = self.done[-1][2][-1] - self.done[0][2][0] if self.done and len(self.done[-1][2]) else 0.0
        for held in self.done:
            if held[1]:
                yield from self.finished(*held, whole)


class FlattenRows(_Segments):
    @staticmethod
    def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> Plan:
        return planned(table, options, "flatten")

    def eval(self, table: Row, **options) -> Iterator[tuple]:
        yield from self.taken(table)

    def terminate(self) -> Iterator[tuple]:
        yield from self.ended()

    def unusable(self, row: Row) -> Iterator[tuple]:
        yield (*(row[i] for i in self.plan.kept), None, None, None)

    def finished(self, segment: int, rows: list[Row], t: np.ndarray, f: np.ndarray, w: np.ndarray, whole: float) -> Iterator[tuple]:
        trend = trend_of(t, f, w, self.p, whole)[0] if self.p.method in GLOBAL else slide_segments(t, f, w, self.p, [(0, len(t), t[0], t[-1], len(t) - 1)])
        for row, x, y in zip(rows, trend.tolist(), f.tolist(), strict=True):
            known = x == x and x != 0
            yield (*(row[i] for i in self.plan.kept), segment, x if known else None, y / x if known else None)


class SplineRows(_Segments):
    @staticmethod
    def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> Plan:
        return planned(table, options, "nsplines")

    def eval(self, table: Row, **options) -> Iterator[tuple]:
        yield from self.taken(table)

    def terminate(self) -> Iterator[tuple]:
        yield from self.ended()

    def unusable(self, row: Row) -> Iterator[tuple]:
        yield from ()

    def finished(self, segment: int, rows: list[Row], t: np.ndarray, f: np.ndarray, w: np.ndarray, whole: float) -> Iterator[tuple]:
        yield (*(rows[0][i] for i in self.plan.kept), segment, float(trend_of(t, f, w, self.p, whole)[1]))


def register_sql(spark: SparkSession) -> None:
    """Make ``trend_flatten`` and ``trend_nsplines`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, handler in (("trend_flatten", FlattenRows), ("trend_nsplines", SplineRows)):
        spark.udtf.register(name, udtf(handler))
