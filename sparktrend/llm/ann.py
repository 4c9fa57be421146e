"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and hashes it to the nearest signed axis.
A query probes the axes nearest to it in every table; shards hold a bucket's
vectors (a hot bucket is dealt out over several), rerank them exactly, and the
best of all shards are merged. How many axes to probe comes from a bounded
sample of queries whose true neighbours are found by comparing them with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.llm.common import materialize, scoped

#: Most vectors of a shard (a memory bound: hot buckets are dealt out, never capped).
BLOCK = 50_000


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` hash tables, of which a query probes ``probes`` axes each.

    Without ``probes``, ``calibrated`` derives them from ``sample`` queries, for ``recall``.
    """

    tables: int = 6
    probes: int | None = None
    seed: int = 20
    sample: int = 64
    recall: float = 0.96

    def axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The rotated vectors' coordinates along all signed axes: column 2 i + (1 if negative)."""
        width = 1 << max(0, x.shape[1] - 1).bit_length()
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x
        rng = np.random.default_rng([self.seed, table])
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        return np.stack([y, -y], 2).reshape(len(x), 2 * width)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers, distinct between tables."""
        return np.stack([self.axes(x, t).argmax(axis=1) + t * self.width(x) for t in range(self.tables)], 1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes) bucket numbers, the nearest axes of each table."""
        n = min(self.probes or self.width(x), self.width(x))
        return np.concatenate([np.argsort(-self.axes(x, t), axis=1, kind="stable")[:, :n] + t * self.width(x) for t in range(self.tables)], 1)

    def width(self, x: np.ndarray) -> int:
        return 2 << max(0, x.shape[1] - 1).bit_length()


def hadamard(y: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row (width: a power of 2)."""
    n, h = y.shape[1], 1
    while h < n:
        z = y.reshape(len(y), n // (2 * h), 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), n)
        h *= 2
    return y / np.sqrt(n)


def exact_cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision; equal rows give equal values."""
    return (c * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum(axis=1)))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of 2 that brings its largest component to [0.5, 1): cosines keep every bit, and no square over- or underflows."""
    _, e = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v, -e)


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best among ``vectors``, but for the query's own id; ties to smaller ids."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    for at in range(0, len(queries) if len(vectors) else 0, 256):
        q, qi = queries[at : at + 256], query_ids[at : at + 256]
        near = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))) @ unit.T
        near[qi[:, None] == ids[None, :]] = -np.inf
        n = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
        for i in range(len(q)):
            short = np.flatnonzero((near[i] >= least[i] - 1e-9) & (near[i] > -np.inf))
            score = exact_cosine(q[i], vectors[short])
            order = np.lexsort((ids[short], -score))[:k]
            out.append((np.full(len(order), qi[i]), ids[short][order], score[order]))
    empty = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (empty, empty, np.zeros(0))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is neither null nor zero and holds only finite numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter(fine)


def calibrated(points: DataFrame, queries: Column, k: int, hashing: CrossPolytope) -> CrossPolytope:
    """``hashing`` with as few probes (a power of 2, or all axes) as find ``hashing.recall`` of the true neighbours of at most ``hashing.sample`` queries.

    The sample (the first by a hash of the id) is compared with every row, in
    the tasks that read them; each returns at most k rows a query.
    """
    some = points.filter(F.coalesce(queries, F.lit(False))).dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(hashing.sample).collect()
    if not some:
        return hashing
    ids, x = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some], float)
    x = scaled(x)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column(0).to_numpy(), scaled(_matrix(batch.column(1)))
            if held is not None:
                own, v = np.concatenate([held[0], own]), np.concatenate([held[1], v])
            own, first = np.unique(own, return_index=True)
            v = v[first]
            _, i, _ = best_of(x, ids, v, own, k)
            keep = np.isin(own, i)  # at most k rows a query
            held = own[keep], v[keep]
        if held is not None:
            q, i, s = best_of(x, ids, held[1], held[0], k)
            home = hashing.buckets(held[1][np.searchsorted(held[0], i)])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array(list(home), pa.list_(pa.int64()))], names=["query_id", "vec_id", "score", "home"])

    near = points.mapInArrow(compare, "query_id long, vec_id long, score double, home array<long>").dropDuplicates(["query_id", "vec_id"])
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).collect()  # sample * k rows
    if not true:
        return hashing
    place = {q: n for n, q in enumerate(ids.tolist())}
    order = [np.argsort(-hashing.axes(x, t), axis=1, kind="stable") for t in range(hashing.tables)]
    needed = np.sort([min(int(np.flatnonzero(order[t][place[r["query_id"]]] == r["home"][t] - t * hashing.width(x))[0]) for t in range(hashing.tables)) + 1 for r in true])
    least = int(needed[min(len(needed) - 1, int(np.ceil(hashing.recall * len(needed))) - 1)])
    return replace(hashing, probes=min(1 << (least - 1).bit_length(), hashing.width(x)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@scoped
def nearest(df: DataFrame, queries: Column, k: int = 5, hashing: CrossPolytope = CrossPolytope(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that the tables find for each row where ``queries`` (over the column vec_id) holds.

    Queries for which the probed buckets hold fewer than k vectors are compared
    with every vector (all shards of the first table, which hold each once), so
    each gets k rows, or all candidates where there are fewer. Components of
    any finite size count: vectors are scaled by powers of 2. Vectors null, zero or with null or non-finite components take no part, as
    do rows with a null id or with another length than the commonest (of
    equally common ones, the longest). A query
    never finds its own id; repeated rows count once an id; other columns are
    ignored; an empty table gives no rows.
    """
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    points = usable(df, vec_id, vector)
    head = points.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    if head is None:
        return spark.createDataFrame([], schema)
    points = points.filter(F.size("v") == head["n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, n = np.unique(hashing.buckets(scaled(_matrix(batch.column(1)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], names=["bucket", "n"])

    counted = points.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # tables * axes rows
    hashing = hashing if hashing.probes else calibrated(points, queries, k, hashing)
    numbers = np.zeros(hashing.tables * (2 << max(0, head["n"] - 1).bit_length()), np.int64)
    for r in counted:
        numbers[r["bucket"]] = r["n"]
    block = int(min(BLOCK, max(128, 1.5 * numbers.mean())))
    blocks = np.maximum(1, -(-numbers // block))
    starts = np.concatenate([[0], np.cumsum(blocks)])

    def deal(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
        """Vectors to their shards, queries to those they probe; ``whole``: of the first table, all to all."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), scaled(_matrix(batch.column(1)))
            home = hashing.buckets(x)[:, :1] if whole else hashing.buckets(x)
            rows = np.repeat(np.arange(len(x)), home.shape[1])
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            shard = starts[home.ravel()] + salt[rows] % blocks[home.ravel()]
            parts = [(rows, shard, np.zeros(len(rows), bool))]
            if len(asks := np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))):
                probes = np.tile(np.arange(hashing.width(x)), (len(asks), 1)) if whole else hashing.probed(x[asks])
                rows, b = np.repeat(asks, probes.shape[1]), probes.ravel()
                full = numbers[b] > 0
                rows, b = rows[full], b[full]
                rows, base = np.repeat(rows, blocks[b]), np.repeat(starts[b], blocks[b])
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(blocks[b]) - blocks[b], blocks[b])
                parts.append((rows, base + nth, np.ones(len(rows), bool)))
            for rows, shard, query in parts:
                for at in range(0, len(rows), 20_000):
                    r = rows[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 20_000]), pa.array(query[at : at + 20_000]), pa.array(ids[r]), pa.array([v.tobytes() for v in x[r]], pa.binary())], names=["shard", "query", "id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_ids, held, vectors, ids = -1, [], [], None, None
        for batch in batches:
            shards, asks, all_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(batch.num_rows, -1) if batch.num_rows else None
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks.astype(int)) != 0)) + 1):
                if not len(rows):
                    continue
                if shards[rows[0]] != at:
                    at, held_ids, held, vectors = shards[rows[0]], [], [], None
                if not asks[rows[0]]:  # a shard's vectors come first, then the queries stream by
                    held_ids.append(all_ids[rows])
                    held.append(x[rows])
                elif held:
                    if vectors is None:
                        ids, first = np.unique(np.concatenate(held_ids), return_index=True)
                        vectors = np.concatenate(held)[first]
                    q, i, s = best_of(x[rows], all_ids[rows], vectors, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from deal(batches, whole=True)

    total, first_table = int(starts[-1]), int(starts[hashing.width(np.zeros((0, head["n"])))])

    def searched(rows: DataFrame, how, shards: int) -> DataFrame:
        parts = min(shards, max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = rows.mapInArrow(how, "shard long, query boolean, id long, v binary")
        placed = dealt.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "query")
        found = placed.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = points.withColumn("asks", F.coalesce(queries, F.lit(False)))
    found = materialize(searched(asked, deal, total), "neighbours")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("__full"))
    short = materialize(asked.filter("asks").select("vec_id").distinct().join(full, F.col("vec_id") == F.col("__full"), "left_anti").select(F.col("vec_id").alias("__short")), "short-queries")
    if short.isEmpty():
        return found
    again = asked.join(short, F.col("vec_id") == F.col("__short"), "left").select("vec_id", "v", F.col("__short").isNotNull().alias("asks"))
    rest = searched(again, everywhere, first_table)
    return found.join(short, F.col("query_id") == F.col("__short"), "left_anti").unionByName(rest)
