"""Series too long for one task: time cells, segmentation in two levels, and halos.

A cell is a span of ``width`` of a series' time. Rows are partitioned by
(series, cell), so a series that holds a third of all rows is spread over as
many tasks as it has cells. What a cell must know of its neighbours (where its
first segment began, where its last one ends) comes from a table of one row a
cell. Sliding windows reach at most one cell further, so rows near a border go
to the neighbouring cell as guests.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ``in_cells`` adds to those it needs (__t, __ok).
HELPERS = ("__key", "__cell", "__segment", "__low", "__high", "__last")
#: Rows without a usable time need no order; they are dealt out over this many cells.
SPARE = 1024
_FAR = 2.0**53


def _cell(t: Column, width: float) -> Column:
    return F.floor(F.greatest(F.least(t / width, F.lit(_FAR)), F.lit(-_FAR)))


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def cell_table(rows: DataFrame, tolerance: float) -> DataFrame:
    """One row (__k, __c) a cell of ``rows`` (__key, __cell, __t).

    __base: the number of its first segment; __n: how many segments start
    behind its first row; __start: its first segment's start; __closes: whether
    its last segment ends in it; __stop: that segment's end.
    """
    by_time = Window.partitionBy("__key", "__cell").orderBy("__t")
    step = F.col("__t") - F.lag("__t").over(by_time)
    new = F.coalesce(step > tolerance, F.lit(False)) if tolerance < math.inf else F.lit(False)
    marked = rows.withColumn("__new", new)
    marked = marked.withColumn("__nth", F.sum(F.col("__new").cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cells = marked.groupBy("__key", "__cell").agg(
        F.min("__t").alias("from"), F.max("__t").alias("to"), F.max("__nth").alias("n"),
        F.max(F.when(F.col("__nth") == 0, F.col("__t"))).alias("first_end"), F.max(F.when(F.col("__new"), F.col("__t"))).alias("last_start"),
    )
    along = Window.partitionBy("__key").orderBy("__cell")
    past, ahead = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    gap = F.col("from") - F.lag("to").over(along)
    cells = cells.withColumn("opens", F.lag("to").over(along).isNull() | (gap > tolerance if tolerance < math.inf else F.lit(False)))
    cells = cells.withColumn("closes", F.coalesce(F.lead("opens").over(along), F.lit(True)))
    cells = cells.withColumn("start", F.coalesce("last_start", F.when(F.col("opens"), F.col("from"))))
    cells = cells.withColumn("stop", F.when(F.col("n") > 0, F.col("first_end")).when(F.col("closes"), F.col("to")))
    so_far = F.sum(F.col("opens").cast("long") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.select(
        F.col("__key").alias("__k"), F.col("__cell").alias("__c"), (so_far - F.col("n") - 1).alias("__base"), F.col("n").alias("__n"), F.col("closes").alias("__closes"),
        F.when(F.col("opens"), F.col("from")).otherwise(F.last("start", True).over(past)).alias("__start"),
        F.when(F.col("closes"), F.col("to")).otherwise(F.first("stop", True).over(ahead)).alias("__stop"),
    )


def in_cells(df: DataFrame, series: Sequence[str], row_id: str | None, tolerance: float, width: float) -> DataFrame:
    """``df`` (with __t, __ok) and the columns ``HELPERS``: its segment's number, start and end, and whether it is that segment's last row.

    Numbers are those of ``segments.segment``. Rows that aren't __ok have nulls.
    """
    key = F.struct(*[_quoted(s) for s in series]) if series else F.struct(F.lit(0).alias("all"))
    spare = F.pmod(F.xxhash64(_quoted(row_id)), F.lit(SPARE)) if row_id else F.spark_partition_id().cast("long") % SPARE
    placed = df.withColumns({"__key": key, "__cell": F.when(F.col("__ok"), _cell(F.col("__t"), width)).otherwise(spare)})
    cells = cell_table(placed.filter("__ok").select("__key", "__cell", "__t"), tolerance)
    joined = placed.join(cells, (F.col("__key") == F.col("__k")) & (F.col("__cell") == F.col("__c")), "left").drop("__k", "__c")
    by_time = Window.partitionBy("__key", "__cell", "__ok").orderBy("__t", *([_quoted(row_id)] if row_id else []))
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("__t") - F.lag("__t").over(by_time)
    new = F.coalesce(step > tolerance, F.lit(False)) if tolerance < math.inf else F.lit(False)
    numbered = joined.withColumn("__new", new).withColumns({"__nth": F.sum(F.col("__new").cast("long")).over(so_far), "__from": F.last(F.when(F.col("__new"), F.col("__t")), True).over(so_far)})
    local = Window.partitionBy("__key", "__cell", "__ok", "__nth")
    ends = numbered.withColumns({"__to": F.max("__t").over(local), "__end": F.lead("__t").over(local.orderBy("__t", *([_quoted(row_id)] if row_id else []))).isNull()})
    inner = F.col("__nth") < F.col("__n")
    ok = lambda c: F.when(F.col("__ok"), c)
    return ends.withColumns({
        "__segment": ok((F.col("__base") + F.col("__nth")).cast("int")), "__low": ok(F.when(F.col("__nth") == 0, F.col("__start")).otherwise(F.col("__from"))),
        "__high": ok(F.when(inner, F.col("__to")).otherwise(F.col("__stop"))), "__last": ok(F.col("__end") & (inner | F.col("__closes"))),
    }).select(*[_quoted(c) for c in df.columns], *HELPERS)


def with_guests(rows: DataFrame, reach: float, width: float, payload: Sequence[str]) -> DataFrame:
    """``rows`` of ``in_cells``, those within ``reach`` of a neighbouring cell there as well; __home tells them apart.

    A guest's ``payload`` columns are null. The last row of a segment is never a guest: no window holds it.
    """
    far = 1.001 * reach  # beyond what rounding could take from a window
    cells = F.array_distinct(F.array(F.col("__cell"), _cell(F.col("__t") - far, width), _cell(F.col("__t") + far, width)))
    dealt = rows.withColumn("__at", F.explode(F.when(F.col("__ok") & ~F.col("__last"), cells).otherwise(F.array("__cell"))))
    home = F.col("__at") == F.col("__cell")
    kept = [_quoted(c) for c in rows.columns if c not in payload]
    return dealt.select(*kept, *[F.when(home, _quoted(c)).alias(c) for c in payload], "__at", home.alias("__home"))
