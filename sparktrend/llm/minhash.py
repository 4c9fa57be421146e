"""Document fingerprints by MinHash.

A text's shingles are hashed to 64 bits; ``SLOTS`` multiply-shift functions
(a 2-universal family) permute them in vectorised numpy, and a byte of each
function's least value fills one slot. Bands of slots are joined in Spark: texts
with an equal band form a candidate group, and within groups the Jaccard
similarity of the shingles themselves decides (``links.verified_links``).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import LOWER, discard, in_slots, materialize, scoped, shingles, small_batches
from sparktrend.llm.links import HOT, SIMILARITY, WORDS, bucket_count, bucketed, node_of, parities, posting_groups, postings, pruned_groups, set_key, shingle_set, verified_links

#: Slots of a fingerprint; the standard error of a likeness is at most 0.5 / sqrt(SLOTS).
SLOTS = 128
#: Bands and slots of a band: a pair at a similarity of 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
#: Bands that are joined first. They link most copies, whose further bands then need no comparison.
FIRST = 3
#: Documents of the sample that shows which bands very many documents share; it sets the speed, not the result.
SAMPLE = 4_000
#: What separates words, and the end of a text.
SPACES = ("", " ", "\t", "\n", "\v", "\f", "\r")
_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DOCUMENT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def signature(hashes: np.ndarray) -> np.ndarray:
    """A byte of each function's least value over ``hashes``, in blocks of bounded size."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        x = hashes[k : k + 4096, None] * _A
        x += _B
        np.minimum(least, x.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint8)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The Jaccard similarity that the share of equal slots tells: different values have the same byte once in 256."""
    return max(0.0, float(((one == other).mean() * 256 - 1) / 255))


def fingerprint(text: str) -> str:
    """A text's signature as hexadecimal, 2 digits a slot."""
    return signature(shingle_set(text)).tobytes().hex()


def spliced(head: str, tail: str, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The shingles of head + tail in order, where ``before`` and ``after`` are those of the texts that begin with head and with tail.

    Shingles of words that lie whole in one of both are taken over; only those
    across the border and around a cut word are hashed.
    """
    words = (head + tail).encode().translate(LOWER).split()
    whole, ends, begins, stops = head.encode().split(), head[-1:] not in SPACES, tail[:1] not in SPACES, tail[-1:] not in SPACES
    if len(words) <= WORDS or len(before) < 2 or len(after) < 2:  # one shingle may be of a shorter text
        return shingles(head + tail, WORDS, 7)
    known = max(0, len(whole) - ends - WORDS + 1)  # of the first words, all that aren't cut
    of_tail = len(tail.encode().split())
    first = int(ends and begins and bool(whole) and of_tail > 0)  # a word that both share
    at = len(words) - of_tail + first
    more = max(0, of_tail - first - stops - WORDS + 1)
    out = np.empty(len(words) - WORDS + 1, np.uint64)
    out[:known] = before[:known]
    if more:
        out[at : at + more] = after[first : first + more]
    joined = [b" ".join(words[i : i + WORDS]) for i in [*range(known, min(at, len(out)) if more else len(out)), *range(at + more, len(out) if more else 0)]]
    out[[*range(known, min(at, len(out)) if more else len(out)), *range(at + more, len(out) if more else 0)]] = [xxhash.xxh64_intdigest(j, 7) for j in joined]
    return out


def band_values(slots: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit hashes of the bands of the signatures ``slots`` (rows, SLOTS); different bands differ."""
    x = slots[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    x = (x * _MIX).sum(axis=2, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _order(doc: object, digest: str) -> tuple:
    """Ascending in the reverse of the documents' order: by id, then by digest; null ids lowest."""
    return (0, 0, digest) if doc is None else (1, doc, digest)


def _edited(df: DataFrame, doc_id: str, text: str, partitions: int | None) -> DataFrame:
    """``edit_with_next`` with binary fingerprints and key, n, bits (of the set of shingles), row (a hash of the text)."""
    df = small_batches(df)
    spark = df.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.md5(t).alias("digest"), t.alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = base.select("doc_id", "digest")
    some = ids.orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(16 * n).collect()  # as many as there are ranges, 16 times
    drawn = sorted(_order(r["doc_id"], r["digest"]) for r in some)
    bounds = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []
    cuts = spark.sparkContext.broadcast(bounds)  # fewer than there are partitions

    def shard(doc: object, digest: str) -> int:
        """0 holds the largest ids; a document of each range's bound is its first from below."""
        return len(cuts.value) - bisect_right(cuts.value, _order(doc, digest))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for doc, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to, own = shard(doc, digest), _order(doc, digest)
                if to not in best or own > best[to]:
                    best[to] = own
        found = sorted(best.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v[1] if v[0] else None for _, v in found], base_type[0]), pa.array([v[2] for _, v in found], pa.string())], names=["shard", "doc_id", "digest"])

    base_type = [ids.limit(0).toArrow().schema.field("doc_id").type]
    heads: dict[int, tuple] = {}
    for r in ids.mapInArrow(largest, f"shard int, doc_id {kind}, digest string").groupBy("shard").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "digest")).alias("m")).collect():  # a row for each range
        heads[r["shard"]] = _order(r["m"]["doc_id"], r["m"]["digest"])
    present = sorted(heads)
    before = {s: present[i - 1] for i, s in enumerate(present)}  # cyclic: the first range's head follows the last range
    known = spark.sparkContext.broadcast((heads, before))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text compressed, once a task for each id; the copies' number follows at the end. Heads go to the range before as guests, too."""
        squeeze, copies = zstandard.ZstdCompressor(level=3).compress, Counter()
        heads, before = known.value
        names, types = ["doc_id", "digest", "blob", "to", "guest", "copies"], [base_type[0], pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        whole = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)
        for batch in batches:
            rows = []
            for doc, digest, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (own := _order(doc, digest)) in copies:
                    copies[own] += 1
                    continue
                copies[own], to, blob = 0, shard(doc, digest), squeeze(t.as_py().encode())
                rows.append((doc, digest, blob, to, 0, 1))
                if heads[to] == own:
                    rows.append((doc, digest, blob, before[to], 1, 1))
            yield whole(rows)
        rest = [(own[1] if own[0] else None, own[2], None, shard(own[1] if own[0] else None, own[2]), 0, k) for own, k in copies.items() if k]
        for k in range(0, len(rest), 10_000):
            yield whole(rest[k : k + 10_000])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last, times, at = None, 0, None  # (id, digest, text, set, signature, shingles) that waits for its successor; how often it occurs

        def finish(one: tuple, other: tuple, times: int) -> tuple:
            doc, digest, t, own, sig, ordered = one
            cut = len(t) - len(t) // 3
            head, tail = t[:cut], other[2][: len(t) - cut]
            edited, key = head + tail, set_key(own)
            new = signature(np.unique(spliced(head, tail, ordered, other[5]))) if edited != t else sig
            return (doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), sig.tobytes(), new.tobytes(), likeness(sig, new), likeness(sig, other[4]), key, node_of(key), len(own), parities(own), digest, times)

        for batch in batches:
            out = []
            for doc, digest, blob, to, guest, copies in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if last is not None and not guest and (doc, digest) == last[:2]:
                    times += copies
                    continue
                if guest and (last is None or at != to):
                    continue  # only the first guest, the least in the order, follows the range
                t = expand(blob).decode()
                ordered = shingles(t, WORDS, 7)
                own = np.unique(ordered)
                one = (doc, digest, t, own, signature(own), ordered)
                if last is not None and at == to:
                    out.append(finish(last, one, 1))
                    if times > 1:  # copies follow each other
                        out.append(finish(last, last, times - 1))
                last, times, at = (None if guest else one), copies, to
            columns = list(zip(*out, strict=True)) if out else [[]] * 13
            kinds = (base_type[0], pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "key", "node", "n", "bits", "digest", "times"])

    parts = len(bounds) + 1
    sent = base.mapInArrow(pack, f"doc_id {kind}, digest string, blob binary, to int, guest int, copies long")
    # Of one document's rows those with a text come first.
    placed = sent.repartitionById(parts, F.col("to")).sortWithinPartitions("to", "guest", F.col("doc_id").desc_nulls_last(), F.desc("digest"), F.col("blob").isNull())
    paired = placed.mapInArrow(pair, f"doc_id {kind}, {_DOCUMENT}, key binary, node long, n long, bits binary, digest string, times long")
    return paired.withColumn("time", F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(1), F.col("times"))).otherwise(F.array(F.lit(1).cast("long"))))).drop("times", "time")


def edit_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Documents are taken in descending ``doc_id`` (of any type that sorts; then
    by a digest of the text; null ids last, in the order of their digests), and
    after the last comes the first. The edited text has the last floor(n / 3)
    code points replaced by as many (or all) first ones of the next text.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts are empty; repeated rows follow each
    other; a single document is its own next; an empty table gives no rows;
    other columns are ignored.

    Texts travel once, compressed, however often a row repeats in a task.
    Ranges are cut by a sample of (id, digest), so equal and null ids are dealt
    out as well, and the first document of each range goes to the range before
    it as a guest.
    """
    return _shown(_edited(df, doc_id, text, partitions))


def _shown(edited: DataFrame, *more: str) -> DataFrame:
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return edited.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", *more)


def class_components(signed: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """(key, class_id, component_id) of the sets of shingles of ``signed`` (doc_id, key, node, n, bits, fingerprint, digest), whose fingerprints have a byte a slot. ``texts``: (row: a hash of the digest, text)."""
    least = signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.min("digest").alias("digest"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(least, "minhash-classes")
    spark = classes.sparkSession
    total = classes.count()
    share = int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000) + 1
    some = signed.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).select("key", "fingerprint").dropDuplicates(["key"]).toArrow().column("fingerprint").to_pylist()
    values, times = np.unique(band_values(np.frombuffer(b"".join(some), np.uint8).reshape(-1, SLOTS)), return_counts=True)
    hot = spark.sparkContext.broadcast(values[times / min(share / 1_000_000, 1.0) >= HOT])  # at most SAMPLE * BANDS
    buckets = bucket_count(spark, total * BANDS)

    def posted(first: int, last: int) -> DataFrame:
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # a class leaves a task once
            for batch in batches:
                nodes = batch.column(0).to_pylist()
                fresh = [i for i, node in enumerate(nodes) if node not in seen and not seen.add(node)]
                if not fresh:
                    continue
                slots = np.frombuffer(b"".join(batch.column(2)[i].as_py() for i in fresh), np.uint8).reshape(-1, SLOTS)
                value = band_values(slots)[:, first:last].ravel()
                node, n = (np.repeat(batch.column(c).to_numpy()[fresh], last - first) for c in (0, 1))
                yield bucketed(value, postings(value, node, n, np.ones(len(value), bool), np.isin(value, hot.value)), buckets)

        return signed.select("node", "n", "fingerprint").mapInArrow(post, "bucket long, postings binary")

    at, made = classes.withColumn("at", F.col("node")), [classes]
    for first, last in ((0, FIRST), (FIRST, BANDS)):
        groups = materialize(posting_groups(posted(first, last), similarity).join(at.select("node", "at"), "node"), "minhash-groups")
        pruned = pruned_groups(groups, at, similarity)
        members = at.join(pruned, "node").select(F.xxhash64("digest").alias("row"), "key", "at", "n", "group")
        label = verified_links(texts, members, similarity, words).withColumnRenamed("id", "at")
        at = materialize(at.join(label, "at", "left").withColumn("at", F.coalesce("component", "at")).drop("component"), "minhash-linked")
        made += [pruned, at]
    ids = at.groupBy("at").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes"))
    out = materialize(at.join(ids, "at").select("key", "class_id", "component_id"), "minhash-components")
    discard(*made)
    return out


@scoped
def fingerprints(df: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """``edit_with_next``, and of each document its near-duplicates: class_id, component_id.

    A class is a distinct set of shingles of five words, named by its smallest
    doc_id. Classes link if a band of their fingerprints is equal and the
    Jaccard similarity of their shingles is ``similarity`` or more;
    component_id is the smallest doc_id of the classes that links lead to. All
    pairs of a band are decided, unless they are connected already. Rows with a
    null doc_id get their class's result (null if all its ids are null).
    """
    edited = materialize(_edited(df, doc_id, text, partitions), "minhash-edited")
    return _shown(with_components(edited, hashed_texts(df, text), similarity), "class_id", "component_id")


def hashed_texts(df: DataFrame, text: str) -> DataFrame:
    """(row, text): ``row`` is a hash of the text's MD5, as in ``class_components``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.xxhash64(F.md5(t)).alias("row"), t.alias("text"))


def with_components(signed: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """``signed``, a written table as in ``class_components``, with class_id and component_id. Only documents that share their class or component with others are joined."""
    id_type = signed.schema["doc_id"].dataType
    found = class_components(signed.select("doc_id", "key", "node", "n", "bits", "fingerprint", "digest"), texts, similarity, words)
    many = signed.groupBy("key").agg((F.count("*") > 1).alias("several"))
    more = found.join(many, "key").filter(~F.col("component_id").eqNullSafe(F.col("class_id")) | F.col("several"))
    more = materialize(more.select(F.col("key").alias("k"), "class_id", "component_id"), "minhash-more")
    alone = in_slots(signed, F.xxhash64("key"), more, F.xxhash64("k"), inside=False).withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
    rest = in_slots(signed, F.xxhash64("key"), more, F.xxhash64("k")).join(more, F.col("key") == F.col("k"), "left")
    joined = rest.withColumns({c: F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col(c)).cast(id_type) for c in ("class_id", "component_id")})
    return alone.unionByName(joined.drop("k"))


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, component_id) of every row of ``df``: see ``fingerprints``.

    Null texts are empty; repeated rows are repeated; other columns are
    ignored; an empty table gives no rows.
    """
    return fingerprints(df, similarity, doc_id, text).select("doc_id", "class_id", "component_id")
