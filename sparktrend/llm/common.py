"""Shared helpers: table access, durable intermediate tables, and row ids."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar
from functools import wraps

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, a checkpoint directory that the caller has
    set counts, and with a local master a folder of this machine. On a cluster
    without either this raises ValueError: executors would write each to its
    own disk.
    """
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparktrend-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths of the tables written within the innermost ``scoped`` call.
_tables: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tables", default=None)


def scoped[**P, R](operator: Callable[P, R]) -> Callable[P, R]:
    """``operator``, after which only those of the tables that it has written by ``materialize`` remain which the DataFrame that it returns reads.

    The remaining ones belong to the scoped call around it, if there is one.
    Tables that a DataFrame reads in scalar subqueries alone don't count as read.
    """

    @wraps(operator)
    def run(*args: P.args, **options: P.kwargs) -> R:
        own: list[tuple[SparkSession, str]] = []
        token, read = _tables.set(own), set()
        try:
            out = operator(*args, **options)
            if isinstance(out, DataFrame) and own:
                read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
            return out
        finally:
            _tables.reset(token)
            for spark, path in own:
                if path.rsplit("/", 1)[-1] not in read:
                    delete_path(spark, path)
                elif (outer := _tables.get()) is not None:
                    outer.append((spark, path))

    return run


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with committed files, so that a lost executor costs
    a re-read instead of a recomputation, and a map stage runs once instead of
    once for each use. ``discard`` deletes the files, and so does the end of a
    ``scoped`` operator.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (held := _tables.get()) is not None:
        held.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``materialize``'s tables, which nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t._written)


#: Slots of ``in_slots``, a bit each; a row of its broadcast holds ``PAGE`` of them.
SLOTS, PAGE = 1 << 26, 1 << 15


def in_slots(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose key (a long hash) shares its last 26 bits with a key of ``wanted``, or else the others.

    A cheap first sieve before a join that would shuffle wide rows: what is
    broadcast is a bitmap of ``SLOTS`` bits at most (8 MB), whatever the size
    of the tables. As these fill up it keeps more and more rows, in the end
    all. Keys aren't null.
    """
    page, place, bits = (fresh(f"__{n}", df.columns) for n in ("page", "place", "bits"))
    spot = lambda k: F.pmod(k, F.lit(SLOTS))
    pages = wanted.select(spot(wanted_key).alias("s")).groupBy(F.shiftright("s", 15).alias(page)).agg(F.bitmap_construct_agg(F.col("s") % PAGE).alias(bits))
    joined = df.withColumns({page: F.shiftright(spot(key), 15), place: (spot(key) % PAGE).cast("int")}).join(F.broadcast(pages), page, "left")
    octet = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(octet.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col(place) % 8 + 1)) > 0, F.lit(False))
    return joined.filter(held if inside else ~held).select(*[F.col(f"`{c}`") for c in df.columns])


#: Keys that hold more than one in so many of all rows are hot: ``join_spread`` broadcasts their rows, which are fewer than that.
HOT_KEYS = 1_000


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` joined with ``right``, a written table that has each key once and in ``weight`` how many rows of ``left`` hold it.

    The rows of hot keys meet ``right`` where they are, so no task gets more
    than one in ``HOT_KEYS`` of all rows for one key. ``left`` is read twice.
    """
    limit = (right.agg(F.sum(weight)).head()[0] or 0) / HOT_KEYS
    hot = right.filter(F.col(weight) > limit)
    many = left.join(F.broadcast(hot), key)
    few = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(weight) <= limit), key)
    return many.unionByName(few)


#: Most rows of an Arrow batch: whole texts are large, and a batch is held by the JVM and the worker at once.
BATCH_ROWS = 200


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` on a copy of its session whose Arrow batches hold at most ``BATCH_ROWS`` rows; the caller's session stays as it is.

    What is derived from it belongs to that copy: temporary views made of it
    are seen there.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        return df
    copy = spark._jsparkSession.cloneSession()
    copy.conf().set(key, str(BATCH_ROWS))
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    return DataFrame(plan, SparkSession(spark.sparkContext, copy))


def labelled_texts(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, y, text) for ``chosen`` (id, y), of bounded size: with the text of each id, or of several the least by hash. There are no more rows than in ``chosen``, however often an id repeats among ``docs``."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    wanted = own.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    one = wanted.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.join(F.broadcast(chosen), "id").select("id", "y", F.col("least.text").alias("text"))


def shingles(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (A-Z lowered, space-joined), repeats included; a shorter text is one run, an empty one the empty run."""
    w = text.encode().translate(LOWER).split()
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = (np.cumsum([len(x) + 1 for x in w]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-words])]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], np.uint64)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until it clashes with none of ``taken`` (in any case)."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name
