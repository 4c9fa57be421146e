"""SimHash near-duplicates by vantage-point trees.

Two fingerprints within ``radius`` bits differ by at most floor(radius /
bands) bits in one of ``bands`` parts of the 64 bits. So there is a tree for
each part, whose metric is the Hamming distance on that part (a node may use
the distance on all 64 bits with the full radius where that prunes better).
A node splits by the distance d to its vantage point at m: a point lives on
one side, and visits the other as well only if the triangle bound allows a
partner there (d - r <= m, d + r > m). Leaves are shards: each holds its own
points and the visitors from across its boundaries, so every pair within the
radius meets in a shard. In a shard a local tree of the same kind goes on.

Shards return stars instead of pairs; components follow from them by
distributed minimum stars and pointer jumping (``links``).

``similar_components`` links texts by the Jaccard similarity of their shingles
instead: trees over the fingerprints of their sets of shingles gather groups
of candidates, and within each group the similarity itself decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import discard, fresh, in_slots, materialize, scoped, shingles, small_batches
from sparktrend.llm.links import HOT, SIMILARITY, bucket_count, bucketed, components, document_rows, linked_components, node_of, parities, posting_groups, postings, pruned_groups, set_key, shingle_set, verified_links

FULL = (1 << 64) - 1
#: Distinct fingerprints that a shard should hold, and beyond which it is dealt out in blocks.
SHARD, CROWDED = 1500, 12_000
#: Most shards a tree; with SAMPLE points each, they bound what the driver sees.
SHARDS, SAMPLE = 8192, 48
#: Fingerprints that are routed through a tree at once.
ROUTED = 20_000


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[k : k + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: A-Z lowered; runs of ``words`` words, repeats included; a bit is set if over half of the XXH64 values set it; 0 without words."""
    return majority(shingles(text, words, seed)) if text.encode().strip() else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py() or "") for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    base = small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema[0].dataType.simpleString()}, fp long")


def band_masks(bands: int) -> list[int]:
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Node:
    """A split by the distance to ``vantage`` under ``mask``: low side <= middle; or a leaf if low is None."""

    leaf: int = -1
    vantage: np.uint64 = np.uint64(0)
    mask: np.uint64 = np.uint64(0)
    radius: int = 0
    middle: int = 0
    low: Node | None = None
    high: Node | None = None


def build_tree(points: np.ndarray, mask: int, part_radius: int, radius: int, least: int, seed: int = 1) -> tuple[Node, list[int]]:
    """A tree on ``points``, and how many of them each leaf holds.

    A node takes, of a few vantage points and both metrics, the split that
    makes the sides with their visitors smallest; without one that gains
    anything, or with ``least`` points or fewer, it is a leaf.
    """
    rng, sizes = np.random.default_rng(seed), []
    metrics = [(np.uint64(mask), part_radius), (np.uint64(FULL), radius)] if mask != FULL else [(np.uint64(FULL), radius)]

    def grow(rows: np.ndarray) -> Node:
        best = None
        if len(rows) > least:
            for v in points[rng.choice(rows, min(4, len(rows)), replace=False)]:
                for m, r in metrics:
                    d = np.bitwise_count((points[rows] ^ v) & m).astype(np.int64)
                    low = int(np.partition(d, len(d) // 2)[len(d) // 2])
                    for middle in {low, max(low - 1, 0)}:
                        inside = int((d <= middle).sum())
                        if not 0 < inside < len(d):
                            continue
                        cost = inside * int((d - r <= middle).sum()) + (len(d) - inside) * int((d + r > middle).sum())
                        if cost < 0.9 * len(d) ** 2 and (best is None or cost < best[0]):
                            best = (cost, v, m, r, middle, d <= middle)
        if best is None:
            sizes.append(len(rows))
            return Node(leaf=len(sizes) - 1)
        _, v, m, r, middle, inside = best
        return Node(-1, v, m, r, middle, grow(rows[inside]), grow(rows[~inside]))

    return grow(np.arange(len(points))), sizes


def route(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) for every leaf a point lives in or visits."""
    out = []

    def walk(node: Node, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if node.low is None:
            out.append((rows, np.full(len(rows), node.leaf), home))
            return
        d = np.bitwise_count((points[rows] ^ node.vantage) & node.mask).astype(np.int64)
        inside = d <= node.middle
        goes = d - node.radius <= node.middle
        walk(node.low, rows[goes], home[goes] & inside[goes])
        goes = d + node.radius > node.middle
        walk(node.high, rows[goes], home[goes] & ~inside[goes])

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass(frozen=True)
class Links:
    """Fingerprints within ``radius`` bits link; ``bands``: the parts that get a tree each."""

    radius: int = 3
    bands: int = 2

    def shard_labels(self, fp: np.ndarray, index: np.ndarray, query: np.ndarray, mask: int) -> np.ndarray:
        """Components of the links between ``index`` and ``query`` points of a shard."""
        n, part = len(fp), self.radius // self.bands
        tree, _ = build_tree(fp, mask, part, self.radius, 192, seed=n)
        rows, leaf, home = route(tree, fp)
        order = np.argsort(leaf, kind="stable")
        rows, leaf, home = rows[order], leaf[order], home[order]
        edges_a, edges_b, waiting, label = [], [], 0, np.arange(n)
        for members in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(leaf)) + 1):
            all_, own = rows[members], rows[members][home[members]]
            own, all_ = own[index[own]], all_[query[all_]]
            for k in range(0, len(own), 512):
                some = own[k : k + 512]
                for j in range(0, len(all_), 4096):
                    other = all_[j : j + 4096]
                    a, b = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[other][None, :]) <= self.radius)
                    a, b = some[a], other[b]
                    differ = a != b
                    edges_a.append(a[differ])
                    edges_b.append(b[differ])
                    waiting += len(edges_a[-1])
                    if waiting > 2_000_000:  # fold them, so that a dense shard needs bounded memory
                        label = components(n, np.concatenate([*edges_a, np.arange(n)]), np.concatenate([*edges_b, label]))
                        edges_a, edges_b, waiting = [], [], 0
        return components(n, np.concatenate([*edges_a, np.arange(n)]), np.concatenate([*edges_b, label]))


def merged(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or more, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shard_stars(classes: DataFrame, links: Links) -> DataFrame:
    """(a, b), b < a: for each shard, a's component there has the smallest id b. ``classes``: (id, fp), distinct."""
    spark = classes.sparkSession
    n = classes.count()
    shards = int(min(max(n // SHARD, 1), SHARDS))
    share = min(1.0, shards * SAMPLE / max(n, 1))
    sample = classes.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    points = np.sort(sample.toArrow().column(0).to_numpy()).view(np.uint64)  # about SHARDS * SAMPLE at most
    trees, first = [], 0
    for k, mask in enumerate(band_masks(links.bands)):
        tree, sizes = build_tree(points, mask, links.radius // links.bands, links.radius, max(SAMPLE, len(points) // shards), seed=k + 1)
        blocks = [max(1, round(s / max(share, 1e-9) / CROWDED)) for s in sizes]  # a crowded leaf is dealt out by pairs of blocks
        starts = first + np.cumsum([0, *(b * b for b in blocks)])
        trees.append((tree, mask, np.array(blocks), starts[:-1]))
        first = int(starts[-1])
    total = first
    plan = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, ROUTED):  # a walk through a tree costs the same for few rows as for many
            ids, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for tree, _, blocks, starts in plan.value:
                rows, leaf, home = route(tree, fp.view(np.uint64))
                k = blocks[leaf]
                block = (fp.view(np.uint64)[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % k
                parts = []
                for i in range(int(k.max(initial=1))):
                    now = i < k
                    both = now & (block == i) & home
                    parts.append((rows[now], (starts[leaf] + i * k + block)[now], both[now], np.ones(now.sum(), bool)))
                    now = now & home & (block != i)
                    parts.append((rows[now], (starts[leaf] + block * k + i)[now], np.ones(now.sum(), bool), np.zeros(now.sum(), bool)))
                r, s, index, query = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(ids[r]), pa.array(fp[r]), pa.array(index), pa.array(query)], names=["shard", "id", "fp", "index", "query"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(starts[0], mask) for _, mask, _, starts in plan.value]

        def stars(shard, ids, fp, index, query):
            order = np.argsort(ids, kind="stable")
            ids, fp, index, query = ids[order], fp[order].view(np.uint64), index[order], query[order]
            mask = [m for s, m in masks if s <= shard][-1]
            label = links.shard_labels(fp, index, query, mask)
            far = label != np.arange(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        at = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            for rows in np.split(np.arange(len(columns[0])), np.flatnonzero(np.diff(columns[0])) + 1):
                if not len(rows):
                    continue
                shard = int(columns[0][rows[0]])
                if held and shard != at:
                    yield stars(at, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                at = shard
                held.append([c[rows] for c in columns[1:]])
        if held:
            yield stars(at, *(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = min(total, max(32, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = classes.select("id", "fp").mapInArrow(deal, "shard int, id long, fp long, index boolean, query boolean")
    placed = dealt.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard")
    return placed.mapInArrow(search, "a long, b long").distinct()


@scoped
def near_duplicate_components(docs: DataFrame, links: Links = Links(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component) for every row of ``docs``.

    Equal fingerprints form a class, which enters the search once under its
    smallest doc_id; component is the smallest doc_id reachable over links.
    Null texts are empty, and texts without words share the fingerprint 0.
    Rows with a null doc_id get their class's component but start none (null
    if all ids of a class are null); repeated rows are repeated; other columns
    are ignored; an empty table gives no rows. ``doc_id`` must be an integer.
    """
    prints = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("id")).filter("id is not null"), "classes")
    found = linked_components(shard_stars(classes, links))
    named = materialize(classes.join(found, "id", "left").select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("component")), "components")
    return prints.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component")


#: The fingerprint of a text's set of shingles gathers candidates: one print within the radius, over two parts.
#: What it misses is found by ``rare_groups``, which is exact.
CANDIDATES = Links(3, 2)
#: Texts sampled, and shingles kept at most, to order shingles by how common they are; any order is exact, a good one is fast.
COMMON_TEXTS, COMMON_SHINGLES = 4_000, 200_000

def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes in order, how many texts of a sample hold each, the sample's share) of the shingles that distinct texts of it share most."""
    share = int(min(1.0, COMMON_TEXTS / max(texts.count(), 1)) * 1_000_000) + 1
    some = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["h"])

    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    hashes, n = counted.column(0).to_numpy().view(np.uint64), counted.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order], min(share / 1_000_000, 1.0)


def held_by(own: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many texts of the sample hold each of ``own``, as ``common_shingles`` has it (0: not among those)."""
    if not len(hashes):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return np.where(hashes[at] == own, n[at], 0)


def rarest(own: np.ndarray, hashes: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest of the distinct shingles ``own``, and their counts: so many that a set at least as similar and no larger holds one of them among its own rarest."""
    held = held_by(own, hashes, n)
    first = np.lexsort((own, held))[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
    return own[first], held[first]


def _sets(texts: DataFrame, common: Broadcast, similarity: float) -> DataFrame:
    """(doc_id, row, key, node, n, fp, bits, rare): of the text's set of shingles, the digest, its first 64 bits, the size, the fingerprint (each shingle counts once, as in the similarity), its parities, and its ``rarest`` (8 bytes each), so that texts are cut into shingles once. ``common``: what ``common_shingles`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                own = shingle_set(t.as_py())
                key = set_key(own)
                rows.append((key, node_of(key), len(own), np.uint64(majority(own)).astype(np.int64), parities(own), rarest(own, *common.value[:2], similarity)[0].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "row", "key", "node", "n", "fp", "bits", "rare"])

    return texts.mapInArrow(run, "doc_id long, row long, key binary, node long, n long, fp long, bits binary, rare binary")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, group) of the classes (node, fp): a group's fingerprints are linked, or equal."""
    heads = materialize(classes.groupBy("fp").agg(F.min("node").alias("id")), "heads")
    found = linked_components(shard_stars(heads, CANDIDATES))
    named = heads.join(found, "id", "left").select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("group"))
    return classes.join(named, F.col("fp") == F.col("f")).select("node", "group")


def rare_groups(sets: DataFrame, classes: DataFrame, common: Broadcast, similarity: float) -> DataFrame:
    """(node, group) of the classes (node, at, n, bits) of ``sets`` (node, n, rare; see ``_sets``) such that any similar two of different ``at`` share a group.

    In one order of all shingles, the first |y| - ceil(s |y|) + 1 of a set y and
    the first |x| - ceil(2 s / (1 + s) |x|) + 1 of a set x no larger have one in
    common if their similarity is s or more (prefix filtering). Sets that share
    one form a group, cut where sizes are too far apart; groups of the same
    sets are one, groups of a single ``at`` are dropped, and others are cut
    where parities differ in more bits than similar sets can. Postings travel
    packed, 14 bytes each. Those of a shingle that the sample shows to be in
    very many texts' prefixes are dealt out by text and form one group as they are.
    """
    buckets = bucket_count(sets.sparkSession, (1 - similarity) * (classes.agg(F.sum("n")).head()[0] or 0) + classes.count())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class leaves a task once
        hashes, counts, share = common.value
        for batch in batches:
            shingle, rows = [], []
            for node, n, rare in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                first = np.frombuffer(rare, np.uint64)
                small = np.arange(len(first)) < n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
                shingle.append(first)
                rows.append(postings(first, np.full(len(first), node), np.full(len(first), n), small, held_by(first, hashes, counts) / share >= HOT))
            if rows:
                yield bucketed(np.concatenate(shingle), np.concatenate(rows), buckets)

    posted = sets.select("node", "n", "rare").mapInArrow(post, "bucket long, postings binary")
    groups = posting_groups(posted, similarity).join(classes.select("node", "at"), "node")
    return pruned_groups(materialize(groups, "rare-groups"), classes, similarity)


def _similar_rows(docs: DataFrame, similarity: float, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, root, component) for every row of ``docs``: ``root`` names the component, ``component`` is its smallest doc_id."""
    texts = small_batches(document_rows(docs, doc_id, text))
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))
    prints = materialize(_sets(texts, common, similarity), "similar-sets")
    least = prints.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "node", "n", "fp", "bits")).alias("least"))
    classes = materialize(least.select("key", *(F.col(f"least.{c}").alias(c) for c in ("doc_id", "row", "node", "n", "fp", "bits"))), "similar-classes")
    slim = classes.select("row", "key", F.col("node").alias("at"), "n")
    members = slim.join(candidate_groups(classes).withColumnRenamed("node", "at"), "at")
    found = verified_links(texts, members, similarity)
    linked = classes.withColumn("at", F.col("node")).join(found.withColumnRenamed("id", "at"), "at", "left").withColumn("at", F.coalesce("component", "at")).drop("component", "fp")
    linked = materialize(linked, "similar-linked")
    groups = rare_groups(prints, linked, common, similarity)
    more = verified_links(texts, linked.select("row", "key", "node", "at", "n").join(groups, "node").select("row", "key", "at", "n", "group"), similarity)
    rooted = materialize(linked.select("at", "key", "doc_id").join(more.withColumnRenamed("id", "at"), "at", "left").select(F.col("key").alias("k"), "doc_id", F.coalesce("component", "at").alias("root")), "similar-roots")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = materialize(rooted.select("k", "root").join(ids, "root"), "similar-components")
    out = materialize(prints.select("doc_id", "row", "key").join(named, F.col("key") == F.col("k"), "left").select("doc_id", "row", "root", "component"), "similar-rows")
    discard(prints, classes, linked, groups, rooted, named)
    return out


@scoped
def similar_components(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component) for every row of ``docs``: the smallest doc_id reachable over texts similar enough.

    Texts link at a Jaccard similarity of ``similarity`` or more between their
    sets of shingles of five words (A-Z lowered; shorter texts: one shingle).
    Equal sets form a class. Vantage-point trees over the fingerprints gather
    classes into groups, in which the shingles themselves decide
    (``links.verified_links``). Classes not linked so far are gathered again by
    their rarest shingles (``rare_groups``), which misses no pair. Only texts
    of such groups travel, compressed.

    Null texts are empty; texts without words are equal; rows with a null
    doc_id take part, and component is null if all ids are; rows of one doc_id
    are decided each by its own text; other columns are ignored; an empty table
    gives no rows.
    """
    return _similar_rows(docs, similarity, doc_id, text).select("doc_id", "component")


@scoped
def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each of ``similar_components``: the one with the smallest doc_id (null only if all are).

    Rows are decided each by its own text, so different texts under one doc_id
    both stay. Of rows of one component that share the kept doc_id, the least
    by text stays (any, if equal). Only hashes and ids of rows travel, and the
    rows that ``in_slots`` can't tell from dropped ones.
    """
    row, lost, lost_id, z, first, root = (fresh(f"__{n}", docs.columns) for n in ("row", "loser", "loser_id", "null", "first", "root"))
    found = _similar_rows(docs, similarity, doc_id, text)
    best = F.col("doc_id").eqNullSafe(F.col("component"))
    losers = materialize(found.filter(~best).select(F.col("row").alias(lost), F.col("doc_id").alias(lost_id)).distinct(), "losers")
    own = F.col(f"`{doc_id}`").cast("long")
    named = docs.withColumn(row, F.xxhash64(own, F.col(f"`{text}`")))
    same = (F.col(row) == F.col(lost)) & own.eqNullSafe(F.col(lost_id))
    sieve = lambda inside, wanted: in_slots(named, F.col(row), wanted, F.col(lost), inside)
    roots = found.filter(best).groupBy("root").count().filter("count > 1").select(F.col("root").alias(root))
    again = materialize(found.filter(best).join(roots, F.col("root") == F.col(root)).select(F.col("row").alias(lost), F.col("doc_id").alias(lost_id), root).distinct(), "repeated")
    gone = losers.unionByName(again.select(lost, lost_id))
    kept = sieve(False, gone).unionByName(sieve(True, gone).join(gone, same, "left_anti")).select(*docs.columns)
    if again.isEmpty():
        return kept
    least = sieve(True, again).join(again, same).groupBy(root).agg(F.min(F.struct(F.col(f"`{text}`").isNull().alias(z), F.col(f"`{text}`").alias(text), *[F.col(f"`{c}`").alias(c) for c in docs.columns if c != text])).alias(first))
    return kept.unionByName(least.select(*[F.col(first).getField(c).alias(c) for c in docs.columns]))
