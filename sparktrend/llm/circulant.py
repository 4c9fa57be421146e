"""Near-duplicates by circulant MinHash.

Two permutations give all coordinates of a signature: the first scatters a
text's shingles over a ring of places, the second orders the ring, and
coordinate k is the least of that order, turned by k places, over the text's
shingles. The turned orders of a place are neighbours in memory, so a shingle
costs one contiguous read for all coordinates. Bands of coordinates gather
candidates, and the Jaccard similarity of the shingles themselves decides
(``minhash.with_components``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import LOWER, materialize, scoped, small_batches
from sparktrend.llm.links import SIMILARITY, node_of, parities, set_key, shingle_set
from sparktrend.llm.minhash import SLOTS, hashed_texts, with_components

#: Words of a shingle.
WORDS = 4
#: Places of the ring, a power of 2: the second permutation takes 4 bytes each in a worker. A set of very many
#: more shingles than a 256th of it has equal coordinates with others of its kind, which adds candidates and loses none.
RING = 1 << 20
#: The first permutation: an odd factor and an offset on the ring.
FACTOR, OFFSET = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0x2545F4914F6CDD1D)


@cache
def turned_orders() -> np.ndarray:
    """(RING, SLOTS): row p holds the second permutation at p, p + 1, ... around the ring. A view of one array."""
    order = np.random.default_rng(20220607).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: SLOTS - 1]]), SLOTS)


def places(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: of the ring place that a hash's last bits name."""
    return ((hashes * FACTOR + OFFSET) & np.uint64(RING - 1)).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least turned order of each coordinate over ``hashes``, in blocks of bounded size."""
    least, orders = np.full(SLOTS, RING, np.uint32), turned_orders()
    for k in range(0, len(hashes), 4096):
        np.minimum(least, orders[places(hashes[k : k + 4096])].min(axis=0), out=least)
    return least


def signed_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, key, node, bits, fingerprint, digest) of every row: size, digests and parities of the text's set of shingles, a byte of each coordinate, and the text's MD5. Texts without words have n 0 and nulls."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = small_batches(df).select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in batch.column(1):
                one = one.as_py()
                if not one.encode().translate(LOWER).strip():
                    rows.append((0, None, None, None, None, None))
                    continue
                own = shingle_set(one, WORDS)
                key = set_key(own)
                rows.append((len(own), key, node_of(key), parities(own), signature(own).astype(np.uint8).tobytes(), hashlib.md5(one.encode()).hexdigest()))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n", "key", "node", "bits", "fingerprint", "digest"])

    return base.mapInArrow(run, f"doc_id {base.schema[0].dataType.simpleString()}, n long, key binary, node long, bits binary, fingerprint binary, digest string")


@scoped
def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``.

    n_shingles: distinct shingles of four words (a shorter text is one shingle;
    null, empty and wordless texts have none). Documents link if a band of
    their signatures is equal and the Jaccard similarity of their sets is
    ``similarity`` or more; component_id is the smallest doc_id that links lead
    to, and kept says whether it is the row's own. Texts without words link
    with nothing. Repeated rows are repeated, and copies of the kept id are
    kept. Rows with a null doc_id get their class's component (null if all its
    ids are null) and aren't kept. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    signed = materialize(signed_sets(df, doc_id, text), "circulant-signed")
    linked = with_components(signed.filter("n > 0"), hashed_texts(df, text), similarity, WORDS).select("doc_id", "n", "component_id")
    alone = signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
