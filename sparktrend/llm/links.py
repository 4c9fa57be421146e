"""Which texts of candidate groups are similar enough, decided on the shingles themselves.

A group may hold any number of texts. It is dealt out in blocks of bounded
size: first each block links its own texts, then rounds link the components'
heads, which join the blocks of a group of copies at the cost of a few texts.
Only where that leaves a group in parts do all its texts meet those of its
other blocks, in cells of two times eight blocks. So each pair of a group that
isn't connected already is compared, and no task holds more than such a cell.

Groups come from postings (a value, such as a shingle or a band of slots, and
the set that has it), which travel packed (``posting_groups``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrend.llm.common import discard, in_slots, materialize, shingles, small_batches

#: Words of a shingle, and the Jaccard similarity from which texts are near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Most texts (but for chance, as blocks are dealt by a hash), and about as many shingles, of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1_000_000
#: Most blocks that the comparison of all members takes together: a text travels once for each such wide block.
WIDE = 8
#: Postings that a bucket should hold, and of a value from which on they need no gathering: its name is their group.
POSTINGS, HOT = 500_000, 50_000
#: Fewest bits of a set's parities, and the most sets of a group that are compared by them in one task (larger groups go on whole).
PARITIES, PRUNED = 256, 500
#: Fewest tasks for cells and buckets.
PARTS = 32
#: Most edges whose components one task finds.
FINISHED = 1_000_000
#: Sizes of sets travel as a number of steps of this ratio.
STEP = 1.02
POSTING = np.dtype([("s", "<u4"), ("node", "<i8"), ("size", "<u2")])
SHORT, DEALT = np.uint16(1 << 15), np.uint16(1 << 14)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes in order (null: as the empty text)."""
    return np.unique(shingles(text or "", words, 7))


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def node_of(key: bytes) -> int:
    """The first 64 bits of a key: the name of its class among links."""
    return int.from_bytes(key[:8], "big", signed=True)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked to, over the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if (new == label).all():
            return label
        label = new


def finished_components(edges: DataFrame) -> DataFrame:
    """``linked_components`` of at most ``FINISHED`` edges, by one task: 16 bytes an edge, several times over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if held:
            names, node = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            node = node.reshape(2, -1)
            label = components(len(names), node[0], node[1])
            far = label != np.arange(len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[label[far]])], names=["id", "component"])

    return materialize(edges.select("a", "b").coalesce(1).mapInArrow(run, "id long, component long"), "finished")


def linked_components(stars: DataFrame) -> DataFrame:
    """(id, component) for every id in ``stars`` (a, b) with b < a: the smallest id linked to it.

    Minimum stars: each a hands its other neighbours to its least one, until
    every a has one neighbour; that is a forest whose roots are the answers,
    and pointer jumping finds them. Each round is a written table, and the
    tables of the round before are deleted. When ``FINISHED`` edges or fewer
    are there, one task takes the remaining rounds together.
    """
    edges, old = materialize(stars, "edges"), []
    while True:
        if edges.count() <= FINISHED:
            done = finished_components(edges)
            discard(edges)
            return done
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        if least.filter("n > 1").isEmpty():
            break
        joined = edges.join(least.select(F.col("a").alias("k"), "m"), F.col("a") == F.col("k"))
        handed = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(handed.filter("a <> b").distinct(), "edges")
        discard(edges, least)
        edges = after
    labels, old = least.select("a", F.col("m").alias("r")), [edges, least]
    while True:
        up = labels.select(F.col("a").alias("k"), F.col("r").alias("rr"))
        jumped = materialize(labels.join(up, F.col("r") == F.col("k"), "left").select("a", F.coalesce("rr", "r").alias("r"), F.col("rr").isNotNull().alias("moved")), "jumped")
        discard(*old)
        labels, old = jumped.select("a", "r"), [jumped]
        if jumped.filter("moved").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("r").alias("component"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of the sets have in common."""
    n, out = len(sets), np.zeros((len(sets), len(sets)), np.float32)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, several = np.repeat(np.arange(n), [len(s) for s in sets]), held[place] > 1
    used, place = np.unique(place[several], return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[several][order], place[order]
    for k in range(0, len(used), 4096):
        at = slice(*np.searchsorted(place, [k, k + 4096]))
        holds = np.zeros((n, min(4096, len(used) - k)), np.float32)
        holds[owner[at], place[at] - k] = 1
        out += holds @ holds.T
    return out


def similar_pairs(sets: list[np.ndarray], at: np.ndarray, block: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of the sets of different ``at`` (and, where given, ``block``) whose Jaccard similarity is ``similarity`` or more."""
    size, common = np.array([len(s) for s in sets]), shared_counts(sets)
    fits = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    fits &= at[:, None] != at[None, :]
    if block is not None:
        fits &= block[:, None] != block[None, :]
    return np.nonzero(np.triu(fits, 1))


def parities(own: np.ndarray) -> bytes:
    """A bit for each class of hashes modulo a power of 2, twice the set's size at least: whether the set holds an odd number of it. Two sets differ by as many elements as bits, at least."""
    width = max(PARITIES, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1).tobytes()


def bucket_count(spark: SparkSession, postings: float) -> int:
    return max(_parts(spark), int(-(-postings // POSTINGS)))


def _parts(spark: SparkSession) -> int:
    """Tasks for cells and buckets, which are many and of bounded size: the shuffle partitions, as each task costs a worker's start."""
    return max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def postings(value: np.ndarray, node: np.ndarray, size: np.ndarray, short: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A posting for each 64-bit ``value``: its upper half (chance matches only add candidates), the node, and its set's size in steps with the two flags."""
    out = np.zeros(len(value), POSTING)
    out["s"], out["node"] = value >> np.uint64(32), node
    out["size"] = (np.log(size) / np.log(STEP)).astype(np.int64) + np.where(short, SHORT, 0) + np.where(hot, DEALT, 0)
    return out


def bucketed(value: np.ndarray, out: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, postings): packed, a row for each bucket. Postings of hot values are dealt out by node, others by value."""
    spread = np.where(out["size"] & DEALT, out["node"].view(np.uint64) >> np.uint64(1), np.uint64(0))
    bucket = ((value % np.uint64(buckets) + spread % np.uint64(buckets)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out, bucket = out[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(out)]])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["bucket", "postings"])


def posting_groups(posted: DataFrame, similarity: float) -> DataFrame:
    """(node, group) of ``posted`` (bucket, postings): the nodes of a value, at least one of them short, cut where sizes are too far apart.

    Groups of the same nodes are one. A hot value's group is named by the value
    and isn't gathered, so no task holds more than a bucket.
    """
    parts, apart = _parts(posted.sparkSession), int(np.log(1 / similarity) / np.log(STEP)) + 1

    def shared(blobs: list[bytes]) -> pa.RecordBatch:
        held = np.frombuffer(b"".join(blobs), POSTING)
        size, hot = held["size"] & np.uint16((1 << 14) - 1), held["size"] & DEALT > 0
        seen, groups = [held["node"][hot]], [held["s"][hot].astype(np.int64) - (1 << 33)]  # no hash of nodes, but for a negligible chance
        keep = np.flatnonzero(~hot)
        order = keep[np.lexsort((held["node"][keep], size[keep], held["s"][keep]))]
        s, size, node, first = held["s"][order], size[order].astype(np.int64), held["node"][order], held["size"][order] & SHORT > 0
        cuts = np.flatnonzero((s[1:] != s[:-1]) | (size[1:] - size[:-1] > apart)) + 1
        ends = np.append(cuts, len(s))
        starts = np.concatenate([[0], cuts])[: len(ends)]
        known = set()
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if first[a:b].any() and node[a:b].min() != node[a:b].max():
                own = np.unique(node[a:b])
                name = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)
                if name not in known:
                    known.add(name)
                    seen.append(own)
                    groups.append(np.full(len(own), name, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen)), pa.array(np.concatenate(groups))], names=["node", "group"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    if blobs:
                        yield shared(blobs)
                    at, blobs = bucket, []
                blobs.append(blob)
        if blobs:
            yield shared(blobs)

    placed = posted.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    return placed.mapInArrow(gather, "node long, group long").distinct()


def viable(group: int, rows: list[tuple[int, int, int, bytes]], similarity: float) -> list[tuple[np.ndarray, int]]:
    """The parts of a group (node, at, n, bits) that pairs similar enough, for all that sizes and parities tell, hold together."""
    node, at, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
    root, width = np.arange(len(node)), np.array([len(r[3]) for r in rows])
    for w in np.unique(width):  # similar sets have the same width, or one twice the other's, which is folded
        some = np.flatnonzero((width == w) | (width == 2 * w))
        folded = np.zeros((len(some), w // 8), np.uint64)
        for i, k in enumerate(some):
            folded[i] = np.bitwise_xor.reduce(np.frombuffer(rows[k][3], np.uint64).reshape(-1, w // 8))
        for i, a in enumerate(some):
            rest = some[i + 1 :]
            fits = np.flatnonzero((at[rest] != at[a]) & (np.minimum(width[rest], width[a]) == w) & (np.minimum(n[a], n[rest]) >= similarity * np.maximum(n[a], n[rest]) - 1e-9))
            differ = np.bitwise_count(folded[i + 1 :][fits] ^ folded[i]).sum(axis=1, dtype=np.int64)
            near = rest[fits[differ <= (1 - similarity) / (1 + similarity) * (n[a] + n[rest[fits]]) + 1e-9]]
            if len(near):
                joined = np.append(near, a)
                root[np.isin(root, root[joined])] = root[joined].min()
    parts = [np.sort(node[root == r]) for r, size in zip(*np.unique(root, return_counts=True), strict=True) if size > 1]
    return [(p, xxhash.xxh64_intdigest(p.tobytes()) - (1 << 63)) for p in parts]


def pruned_groups(groups: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(node, group): those of ``groups`` (node, group, at; a written table, which is deleted) that hold several ``at``, cut by ``viable`` where they aren't too large. ``classes``: (node, at, n, bits)."""
    sizes = groups.groupBy("group").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("sets")).filter("low < high")
    sizes = materialize(sizes.select("group", "sets"), "sizes")
    several = materialize(groups.select("node", "group").join(sizes, "group"), "several")  # both are written tables, so that the join can be split where a group is large
    discard(groups, sizes)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, done = None, [], set()

        def result() -> pa.RecordBatch:
            found = [(p, g) for p, g in viable(group, rows, similarity) if g not in done]
            done.update(g for _, g in found)
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *(p for p, _ in found)])), pa.array(np.concatenate([empty, *(np.full(len(p), g, np.int64) for p, g in found)]))], names=["node", "group"])

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if g != group:
                    if rows:
                        yield result()
                    group, rows = g, []
                rows.append(row)
        if rows:
            yield result()

    known = several.filter(F.col("sets") <= PRUNED).join(classes.select("node", "at", "n", "bits"), "node").select("group", "node", "at", "n", "bits")
    pruned = known.repartition(_parts(known.sparkSession), "group").sortWithinPartitions("group").mapInArrow(prune, "node long, group long")
    out = materialize(pruned.unionByName(several.filter(F.col("sets") > PRUNED).select("node", "group")).distinct(), "pruned")
    discard(several)
    return out


def document_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, row): ``row`` is a hash of both."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.withColumn("row", F.xxhash64("doc_id", "text"))


def _compare(texts: DataFrame, cells: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b, group, key, row, n), written: the links within the cells (row, key, at, n, group, i, j, block).

    A star of a cell's links is a row a, b with b < a and a null group. A node
    to which a cell of i = j (that is, a block) links no smaller one is a row
    with b null and the member that stands for it. If i <> j, only pairs of
    different blocks count.
    """
    wanted = materialize(cells.groupBy(F.col("row").alias("member"), "key", "at", "n").agg(F.collect_list(F.struct("group", "i", "j", "block")).alias("cells")), "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            rows, blobs = [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row not in seen:  # a repeated row leaves a task once
                    seen.add(row)
                    rows.append(row)
                    blobs.append(squeeze((t.as_py() or "").encode()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["row", "blob"])

    kinds = {"a": pa.int64(), "b": pa.int64(), "group": pa.int64(), "key": pa.binary(), "row": pa.int64(), "n": pa.int64()}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, expand = None, {}, zstandard.ZstdDecompressor().decompress

        def result() -> pa.RecordBatch:
            ats, blocks, rows, sets = zip(*held.values(), strict=True)
            ats, blocks = np.array(ats, np.int64), np.array(blocks)
            a, b = similar_pairs(list(sets), ats, blocks if cell[1] != cell[2] else None, similarity)
            names, first, node = np.unique(ats, return_index=True, return_inverse=True)
            root = components(len(names), node[a], node[b])
            far, own = root != np.arange(len(names)), np.flatnonzero(root == np.arange(len(names))) if cell[1] == cell[2] else np.zeros(0, int)
            keys, none = list(held), [None] * int(far.sum())
            out = [[*names[far], *names[own]], [*names[root[far]], *[None] * len(own)], [*none, *[cell[0]] * len(own)], [*none, *(keys[first[k]] for k in own)], [*none, *(rows[first[k]] for k in own)], [*none, *(len(sets[first[k]]) for k in own)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for g, i, j, block, at, key, row, blob in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (g, i, j) != cell:
                    if held:
                        yield result()
                    cell, held = (g, i, j), {}
                if key not in held and set_key(own := shingle_set(expand(blob).decode(), words)) == key:
                    held[key] = (at, block, row, own)
        if held:
            yield result()

    sieved = in_slots(texts.select("row", "text"), F.col("row"), wanted, F.col("member"))
    joined = sieved.mapInArrow(pack, "row long, blob binary").join(wanted, F.col("row") == F.col("member"))
    dealt = joined.select(F.explode("cells").alias("c"), "at", "key", "row", "blob").select("c.group", "c.i", "c.j", "c.block", "at", "key", "row", "blob")
    placed = dealt.repartition(_parts(texts.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    found = materialize(placed.mapInArrow(decide, "a long, b long, group long, key binary, row long, n long"), "compared")
    discard(wanted)
    return found


def verified_links(texts: DataFrame, members: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(id, component) for the nodes that are linked to a smaller one: the smallest they are linked to.

    ``members`` (row, key, at, n, group): ``at`` is the node that a member
    belongs to. Nodes link if a chain of pairs of members, similar enough and
    each within a group, leads from one to the other; members of one node
    aren't compared. ``texts``: (row, text). ``words``: of a shingle.
    """
    texts = small_batches(texts)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    per_block = F.sum("n") / F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    wide = F.greatest(F.lit(1), F.least(F.lit(WIDE), F.floor(2 * BLOCK_SHINGLES / per_block))).cast("int").alias("wide")  # fewer where texts are long
    given = materialize(members.select("row", "key", "at", "n", "group"), "given")
    sizes = given.groupBy("group").agg(F.min("at").alias("low"), F.max("at").alias("high"), blocks, wide).filter("low < high")
    sizes = materialize(sizes.select("group", "blocks", "wide"), "sizes")
    open_ = materialize(given.join(sizes, "group").select("group", "blocks", "wide", "row", "key", "at", "n"), "members")
    dealt = lambda turn: F.pmod(F.xxhash64("key", F.lit(turn)), F.col("blocks")).cast("int")
    own = lambda rows, turn: rows.withColumn("block", dealt(turn)).select("row", "key", "at", "n", "group", F.col("block").alias("i"), F.col("block").alias("j"), "block")
    rounds = [_compare(texts, own(open_, 0), similarity, words)]
    stars = rounds[0].filter("b is not null").select("a", "b")
    large, last, turn, heads_ = open_.filter("blocks > 1"), None, 0, []
    alone = large.isEmpty()
    while not alone:  # the heads of a large group's blocks meet, as long as that joins them
        turn += 1
        heads = rounds[-1].filter("b is null").select("group", "key", "row", "n", F.col("a").alias("at")).join(large.select("group").distinct(), "group", "left_semi")
        several = materialize(heads.groupBy("group").agg(F.count("*").alias("parts"), blocks).filter("parts > 1"), "heads")
        heads_.append(several)
        total = several.agg(F.sum("parts")).head()[0] or 0
        if not total or last is not None and 2 * total > last:
            break
        last = total
        rounds.append(_compare(texts, own(heads.join(several.select("group", "blocks"), "group"), turn), similarity, words))
        stars = stars.unionByName(rounds[-1].filter("b is not null").select("a", "b"))
    label = linked_components(stars.distinct())
    if not alone:
        named = large.join(label.select(F.col("id").alias("at"), "component"), "at", "left").withColumn("at", F.coalesce("component", "at")).drop("component")
        parted = materialize(named.groupBy("group").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high").select("group"), "parted")
        heads_.append(parted)
        if not parted.isEmpty():  # heads don't join these: compare all members
            mine, other = F.floor(F.col("block") / F.col("wide")).cast("int"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("blocks") / F.col("wide")).cast("int") - 1)).alias("other")
            rest = named.join(parted, "group").withColumn("block", dealt(0)).select("row", "key", "at", "n", "group", "block", mine.alias("mine"), other)
            # Pairs of one block are compared already, so these cells never have i = j.
            cells = rest.select("row", "key", "at", "n", "group", F.least("mine", "other").alias("i"), (F.greatest("mine", "other") + (1 << 20)).alias("j"), "block")
            rounds.append(_compare(texts, cells, similarity, words))
            label = linked_components(stars.unionByName(rounds[-1].filter("b is not null").select("a", "b")).distinct())
    discard(given, open_, sizes, *heads_, *rounds)
    return label
