"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time u in [0, 1]. Its integral
up to u, scaled to end at the source's target, is the source's cumulative token
demand; inverting that demand at the place a document takes within its
source's stream of documents gives the document's training position. Training
order is a range sort by position. Targets come from water filling: weights
share the whole, and a source never exceeds ``most`` times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.llm.common import WORD, fresh, materialize, scoped

#: Buckets into which a source's documents are dealt for the two-level prefix sum.
BUCKETS = 1024
MOST = 3


def word_count(text: Column) -> Column:
    """Runs of non-separators; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column over the rows before in ``order``.

    Rows are dealt out by ranges of the order and written; a table of one row a
    range carries the sums on. No task sorts more than a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, place = [f"__o{i}" for i in range(len(order))], "__range"
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)) | {f"__v_{n}": c for n, c in sums.items()})
    ranged = materialize(keyed.repartitionByRange(parts, *keys).withColumn(place, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(F.col(place).alias("__at")).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    ahead = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select("__at", *[F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(place).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(bases), F.col(place) == F.col("__at"))  # as many rows as there are shuffle partitions
    return joined.select(*rows.columns, *[(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0))).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    In code point order, null last, sources weigh ``weights`` in turn. Water
    filling: with level v, a source gets min(most * size, v * weight); v is the
    level at which all shares add up to the sum of sizes. Sorting sources by
    the level at which they are full turns it into prefix sums, which are dealt
    out by ranges: there may be as many sources as there are documents.
    """
    name = [F.col("source").isNull(), F.coalesce(F.col("source"), F.lit("")).cast("binary")]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = running_sums(sizes, name, {"__nth": F.lit(1)})
    weighed = placed.withColumn("w", F.element_at(cycle, (F.pmod("__nth", F.lit(len(weights))) + 1).cast("int"))).drop("__nth")
    weighed = weighed.withColumn("full", most * F.col("source_size") / F.col("w"))
    summed = running_sums(weighed, [F.col("full"), *name], {"__filled": most * F.col("source_size"), "__w": F.col("w")})
    whole = summed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w"))
    level = (whole.select("size").scalar() - F.col("__filled")) / (whole.select("w").scalar() - F.col("__w"))
    leveled = materialize(summed.withColumn("level", level), "levels")
    # The first source that its level doesn't fill sets the level; later ones would set lower levels.
    final = leveled.filter(F.col("level") <= F.col("full")).agg(F.max("level")).scalar()
    return leveled.select("source", "source_size", F.round(F.least((most * F.col("source_size")).cast("double"), final * F.col("w")), 6).alias("target"))


def demand_inverse(share: Column, slope: Column) -> Column:
    """Training time u at which the share of a source's demand is met.

    The schedule is 1 + slope * (2 u - 1), slope in (-1, 1); its integral,
    (1 - slope) u + slope u^2, is inverted in a form that is stable at slope 0.
    """
    a = 1 - slope
    return 2 * share / (a + F.sqrt(a * a + 4 * slope * share))


@scoped
def curriculum_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = MOST, whole: bool = False, seed: str = "mix", tasks: int | None = None, ranges: int | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken and positions.

    Added (replacing columns of these names in any case): size (words), the
    source's source_size and target, ``taken`` (words that the mix takes,
    repeats counted), ``position`` (training time of the first take, null if
    none) and ``positions`` (of each take). A source is passed over whole
    target / size times, then once more until its target is reached: taken sums
    to the target rounded, and no document exceeds ``most`` times its size.
    ``whole``: only whole documents are taken (the one at the border, if half
    or more of it is within the target).

    The order in a source is by an MD5 of seed and doc_id (then doc_id; equal
    ids by a hash of the text), so reruns agree. Null and empty texts have size 0 and are
    never taken; a null source is a source of its own; repeated rows count as
    often as they occur; an empty table gives no rows.

    ``tasks`` (default: the shuffle partitions): a bucket is split by the order
    in it, so that one source alone is dealt out over four times as many
    groups. Results don't depend on it.

    ``ranges`` adds ``ranges``: for each of ``positions`` its place among so
    many ranges of training time that take equal shares of all demand (see
    ``training_order``). The demand of all sources up to u is A u + B u^2, so
    no rows are sampled for it.
    """
    new = ("size", "source_size", "target", "taken", "position", "positions", *(["ranges"] if ranges else []))
    kept = [c for c in docs.columns if c.lower() not in new]
    names = ("size", "source", "key", "bucket", "tie", "before", "base", "target", "total", "bend", "of", "at")
    size, src, key, bucket, tie, before, base, target, total, bend, of, at = (fresh(f"__{n}", docs.columns) for n in names)
    quoted = lambda c: F.col(f"`{c}`")
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(quoted(doc_id).cast("string"), F.lit(""))))
    name = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))  # noqa: E731  never null: one exchange serves join and window
    parts = -(-4 * (tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // BUCKETS)
    head = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")
    in_bucket = head % BUCKETS * parts + F.shiftright(head * parts, 32)  # (bucket, place by the key's first 32 bits)
    sized = docs.select(*[quoted(c) for c in kept], word_count(quoted(text)).alias(size), name(quoted(source)).alias(src), hashed.alias(key), in_bucket.alias(bucket), F.xxhash64(quoted(text)).alias(tie))
    sums = docs.select(quoted(source).cast("string").alias("source"), in_bucket.alias("b"), word_count(quoted(text)).alias("n")).groupBy("source", "b").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "source-sums")  # a row for each source and bucket: texts are read for it once
    earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    starts = sums.select("source", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
    slope = F.round((F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") / 65535 - 0.5) * 1.6, 6)
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(name(F.col("source")).alias(of), F.col("b").alias(at), base, F.col("source_size").alias(total), F.col("target").alias(target), slope.alias(bend))
    joined = sized.join(starts, (F.col(src) == F.col(of)) & (F.col(bucket) == F.col(at)))
    within = Window.partitionBy(src, bucket).orderBy(key, quoted(doc_id).cast("string"), tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn(before, F.col(base) + F.coalesce(F.sum(size).over(within), F.lit(0)))
    n, s, t = F.col(size), F.col(total), F.round(F.col(target)).cast("long")
    passes = F.when(s > 0, F.floor(t / s)).otherwise(0).cast("long")
    left = t - passes * s
    more = F.least(n, F.greatest(left - F.col(before), F.lit(0)))
    if whole:
        more = F.when((F.col(before) * 2 + n <= left * 2) & (passes < most), n).otherwise(0)
    taken = F.when(n > 0, passes * n + more).otherwise(F.lit(0)).cast("long")
    takes = F.when(taken > 0, passes + (more > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    share = lambda k: F.least((k * s + F.col(before)) / F.greatest(F.col(target), F.lit(1e-9)), F.lit(1.0))
    positions = F.transform(F.slice(F.array(*[F.lit(k) for k in range(most + 1)]), F.lit(1), takes), lambda k: F.round(demand_inverse(share(k), F.col(bend)), 9))
    out = placed.select(*[quoted(c) for c in kept], n.alias("size"), s.alias("source_size"), F.col(target).alias("target"), taken.alias("taken"), positions.alias("positions"))
    if ranges:
        whole_demand = targets.withColumn("slope", slope).agg(F.sum("target").alias("t"), F.sum(F.col("target") * F.col("slope")).alias("b"))
        b, held = whole_demand.select(F.col("b") / F.greatest("t", F.lit(1e-9))).scalar(), F.col(of)
        place = lambda u: F.least(F.floor(((1 - held) * u + held * u * u) * ranges), F.lit(ranges - 1)).cast("int")
        out = out.withColumn(of, b).withColumn("ranges", F.transform("positions", place)).drop(of)
    return out.withColumn("position", F.when(F.size("positions") > 0, F.element_at("positions", 1)))


def training_order(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """A row for each take of the rows of ``curriculum_mix`` (``options``: its own), sorted by position (ties by doc_id) within and across partitions.

    Partitions are the ranges of the mix. A row knows its own from its
    position, so texts are shuffled once to learn that and once to be there,
    and nothing is computed twice for the bounds.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    take = fresh("__take", docs.columns)
    mixed = curriculum_mix(docs, doc_id, ranges=parts, **options)
    takes = mixed.withColumn(take, F.explode(F.arrays_zip("positions", "ranges"))).withColumn("position", F.col(f"{take}.positions"))
    placed = takes.repartitionById(parts, F.col(f"{take}.ranges")).sortWithinPartitions("position", doc_id)
    return placed.drop(take, "positions", "ranges")
