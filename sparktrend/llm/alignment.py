"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes. A two-pointer merge of their cumulative
token ends, vectorised inside ``mapInPandas``, cuts each text into the smallest
groups on whose borders both agree; the id pairs within a group are links.
Spark counts in how many documents each pair is linked, takes each id's
highest count on either side, and joins them back.

Pairs are many times more than documents, so none travels alone: a task gathers
its documents in chunks of bounded size, and a chunk sends each of its distinct
pairs once, with the number of its documents. A pair that half of the corpus
holds is thus one row a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import materialize, scoped, small_batches

if TYPE_CHECKING:
    import tiktoken

#: Pairs of documents (each counted once a document) that a chunk gathers.
CHUNK = 1_000_000
# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts before they join bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond those whose classes all versions of Unicode agree on, and controls that some take for white space.
ODD = re.compile("[\x1c-\x1f\x7f-\x9f\u0250-\U0010ffff]")
#: Links of a group from which on its pairs come from the distinct ids of both sides.
LARGE = 4_096
MARK = "▁"
_models: dict[tuple[str, str], Tokenizers] = {}


def byte_level() -> dict[str, int]:
    """The byte of each character in byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level one (A, a .json file) and one of pieces (B, a .model file), and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings inside a text are ordinary text
        place, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(place[c] for c in token) if all(c in place for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.ranked = self._ranked(vocabulary)
        # What follows an id in the text of the groups: another of its side, the other side, or the next group.
        self.shown = [*(f"{i}," for i in range(len(self.bytes_a))), *(f"{i}|" for i in range(len(self.bytes_a))), *(f"{i}," for i in range(len(self.bytes_b))), *(f"{i};" for i in range(len(self.bytes_b)))]

    def _ranked(self, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """A faster encoder of A's ids for texts of ``PLAIN`` characters; None unless it is proven to give the same.

        It joins neighbours whose bytes are a token, lowest id first, where A
        applies its list of merges, in order. If ids follow that order, both
        differ only where neighbours make up a token that A would join from
        other parts; but then A, given that token's bytes alone, would not
        return it. So both are equal if A returns each token for its bytes.
        """
        import tiktoken

        model = json.loads(self.a.to_str())
        made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]
        step = model.get("pre_tokenizer") or {}
        plain = model.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        own = {t: i for t, i in vocabulary.items() if t not in special}
        singles = [i for t, i in own.items() if len(t) == 1]
        if not plain or None in made or sorted(made) != made or len(set(made)) != len(made) or len(singles) + len(made) != len(own) or max(singles) > made[0]:
            return None
        if any([x.id for x in self.a.model.tokenize(t)] != [i] for t, i in own.items()):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in own.values()}, special_tokens={})

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both; none where there is no text or a tokenizer changes it."""
        if not text:
            return [], []
        whole = " " + text
        raw = whole.encode()
        a = self.ranked.encode_ordinary(whole) if self.ranked and not ODD.search(text) else self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        return a, b


def tokenizers(a: str, b: str) -> Tokenizers:
    """A worker's tokenizers for these files."""
    if (a, b) not in _models:
        _models[a, b] = Tokenizers(a, b)
    return _models[a, b]


@dataclass
class Groups:
    """For each token of both sides its group, and how many tokens of each side a group has."""

    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @staticmethod
    def merge(length_a: np.ndarray, length_b: np.ndarray) -> Groups:
        """Tokens of these lengths in bytes, over the same bytes: both lists of ends are sorted, so one pass over them finds the ends in common."""
        a, b = np.cumsum(length_a), np.cumsum(length_b)
        ends = np.intersect1d(a, b, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, a), np.searchsorted(ends, b)
        return Groups(of_a, of_b, np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends)))

    def links(self) -> int:
        return int((self.n_a * self.n_b).sum())

    def text(self, a: np.ndarray, b: np.ndarray, t: Tokenizers) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.of_a, self.of_b))
        size_a, size_b = len(t.bytes_a), len(t.bytes_b)
        out[np.arange(len(a)) + (np.cumsum(self.n_b) - self.n_b)[self.of_a]] = a + np.where(last_a, size_a, 0)
        out[np.arange(len(b)) + np.cumsum(self.n_a)[self.of_b]] = b + 2 * size_a + np.where(last_b, size_b, 0)
        return "".join(map(t.shown.__getitem__, out.tolist()))[:-1]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked id pairs, as a << 32 | b in order, and how often each is linked."""
        large = self.n_a * self.n_b > LARGE
        begin = np.cumsum(self.n_b) - self.n_b
        few = np.flatnonzero(~large[self.of_a])
        n = self.n_b[self.of_a[few]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        codes = [np.repeat(a[few] << 32, n) | b[np.repeat(begin[self.of_a[few]], n) + step]]
        times = [np.ones(len(codes[0]), np.int64)]
        first = np.cumsum(self.n_a) - self.n_a
        for g in np.flatnonzero(large):
            (ua, ca), (ub, cb) = np.unique(a[first[g] :][: self.n_a[g]], return_counts=True), np.unique(b[begin[g] :][: self.n_b[g]], return_counts=True)
            codes.append(((ua << 32)[:, None] | ub).ravel())
            times.append((ca[:, None] * cb).ravel())
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return found, total


def squeeze(numbers: np.ndarray) -> bytes:
    """64-bit numbers in order, packed: their steps by byte planes, compressed."""
    steps = np.diff(numbers, prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel())


def grouped(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, chunk, pairs, times) of every row: the merge, without the corpus. No shuffle.

    ``groups`` is the text of the groups, or with ``digest`` its SHA-256 (''
    without tokens). ``pairs`` and ``times`` are packed (``squeeze``).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, task, chunk, held = tokenizers(a, b), TaskContext.get().partitionId(), 0, 0
        for frame in frames:
            rows = []
            for t in frame["text"]:
                ids_a, ids_b = (np.array(x, np.int64) for x in known.ids(t))
                g = Groups.merge(known.length_a[ids_a], known.length_b[ids_b])
                shown = g.text(ids_a, ids_b, known)
                pairs, times = g.pairs(ids_a, ids_b)
                if digest and shown:
                    shown = hashlib.sha256(shown.encode()).hexdigest()
                if held and held + len(pairs) > CHUNK:
                    chunk, held = chunk + 1, 0
                held += len(pairs)
                rows.append((len(ids_a), len(ids_b), len(g.n_a), g.links(), shown, task << 32 | chunk, squeeze(pairs), squeeze(times)))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups", "chunk", "pairs", "times"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    base = small_batches(df).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # Ids travel as text: pandas would turn longs with nulls into doubles.
    named = base.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    done = named.mapInPandas(run, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, pairs binary, times binary")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def chunk_pairs(merged: DataFrame) -> DataFrame:
    """(chunk, a, b, docs): the distinct pairs of each chunk of ``grouped``, and how many of its documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def counted() -> pa.RecordBatch:
            pair, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), at, np.int64)), pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(docs.astype(np.int64))], names=["chunk", "a", "b", "docs"])

        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and chunk != at:
                    yield counted()
                    held = []
                at = chunk
                held.append(expand(blob))
        if held:
            yield counted()

    return small_batches(merged.select("chunk", "pairs")).mapInArrow(run, "chunk long, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs, best_a, best_b): the documents that hold each pair of ``chunk_pairs``, and the highest such number of its A and of its B id."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pair-counts")
    best = lambda side: counts.groupBy(side).agg(F.max("docs").alias(f"best_{side}"))
    # A row for each id of a vocabulary, so their size is bounded whatever the corpus.
    return counts.join(F.broadcast(best("a")), "a").join(F.broadcast(best("b")), "b").select("a", "b", "docs", "best_a", "best_b")


@scoped
def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``df``.

    ``a``: a tokenizers file of a byte-level vocabulary, which gets a space and
    the text; ``b``: a sentencepiece model that adds that space itself; both on
    every executor. Groups are cut where tokens of both end; the links of a
    group are all its pairs of an A and a B token. n_best: links whose pair is
    held by as many documents as any pair of its A id; count_sum: those
    numbers, summed over the links. ``groups``: ids as ``a1,a2|b1;a3|b2,b3``,
    or with ``digest`` the SHA-256 of that.

    Null and empty texts, and those that either tokenizer changes, have no
    tokens: zeros and ''. Texts count whole. Repeated rows are documents of
    their own, also with equal or null ids (integers); other columns are
    ignored; an empty table gives no rows. A task holds a chunk's pairs: at
    most ``CHUNK``, or those of one document, of which there are no more than
    links and no more than id pairs.
    """
    merged = materialize(grouped(df, a, b, doc_id, text, digest), "aligned")
    pairs = materialize(chunk_pairs(merged), "chunk-pairs")
    counts = materialize(pair_counts(pairs), "pairs")
    asked = pairs.select("chunk", "a", "b").join(counts.select("a", "b", "docs", "best_a"), ["a", "b"]).select(F.col("chunk").alias("of"), "a", "b", "docs", "best_a")

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        a_, b_, docs, best = (known.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "docs", "best_a"))
        code = a_ << 32 | b_
        order = np.argsort(code)
        code, docs, top = code[order], docs[order], (docs == best)[order]
        out = []
        for blob, times in zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at, n = np.searchsorted(code, expand(blob)), expand(times)
            out.append((int(n[top[at]].sum()), int((n * docs[at]).sum())))
        n_best, count_sum = zip(*out, strict=True) if out else ((), ())
        return rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups", rows.column("groups"))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return merged.groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(answer, schema)
