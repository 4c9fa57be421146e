"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens. How many pieces there
are of each length is a histogram of at most ``capacity`` numbers whatever the
corpus size, so the driver can plan bins on it: bin completion takes the
largest length left, enumerates undominated fillings of the space around it by
branch and bound, and repeats the chosen filling as often as the histogram
allows. How many patterns a plan has depends on ``capacity`` alone, so
broadcasting it is bounded too. Pieces then find
their place by their rank within their length, which is a two-level prefix sum
(rank in the task, plus what earlier tasks hold), never one task for a hot
length.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.llm.common import materialize, scoped, small_batches

#: Default of the entries of a generation of a worker's word cache (a memory bound; results don't depend on it).
CACHE_ENTRIES = 400_000
#: Default of the branches and fillings that a plan's search tries after its first descent (see ``plan_bins``).
NODES = 2_000
_PLAIN = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_words: dict[str, _Words] = {}


class _Words(dict):
    """Token ids (little-endian uint32 bytes) of white-space separated words, filled on demand.

    Two generations bound the memory and keep what is in use. Letters below
    U+0250 need no normalising but lower case, so words of them skip that part
    of the library's pipeline, and share an entry of their lower-case form and
    of the signs behind them.
    """

    def __init__(self, path: str, entries: int):
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        self.letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": next(s for s in steps if s["type"] == "ByteLevel"), "added_tokens": []}))
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(word)) is None:
            core = word.rstrip(_PLAIN)
            if not core.isalpha() or max(core) >= "\u0250" or "\u0130" in core:
                ids = self.encode(word)
            elif core != word:
                ids = self[core] + self[word[len(core) :]]  # letters, then other signs: two pre-tokens
            elif not word.islower():
                ids = self[word.lower()]
            else:
                ids = array("I", self.letters.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """All of a text's ids. This vocabulary drops white space and never joins across it."""
        if "<|" in text and any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)  # str.split() takes these controls for white space, the vocabulary doesn't
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str, entries: int = CACHE_ENTRIES) -> Callable[[str], bytes]:
    """A worker's encoder for the tokenizers file at ``path``."""
    if path not in _words or _words[path].entries != entries:
        _words[path] = _Words(path, entries)
    return _words[path].text


def cut_pieces(df: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, task, rank.

    A document is its ids and then id 0 (null and empty texts: id 0 alone).
    rank counts the pieces of equal length within the task. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen, width = word_ids(path, entries), TaskContext.get().partitionId(), [0] * (capacity + 1), 4 * capacity
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = encode(t.as_py() or "") + b"\0\0\0\0", doc.as_py()
                for k in range(-(-len(ids) // width)):
                    part = ids[k * width : (k + 1) * width]
                    n = len(part) // 4
                    rows.append((doc, k, k * capacity, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    base = small_batches(df).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long")


@dataclass
class Pattern:
    """``copies`` bins that each hold ``items``: (length, how many)."""

    items: list[tuple[int, int]]
    copies: int


def _bits(x: int) -> Iterator[int]:
    """Places of the bits of ``x``, highest first."""
    while x:
        top = x.bit_length() - 1
        yield top
        x ^= 1 << top


def _undominated(filling: list[tuple[int, int]], counts: list[int], waste: int) -> bool:
    """Whether no length that is left over could take the place of some of the filling's pieces, wasting less or holding fewer pieces.

    Such an exchange never costs a bin: what it takes out fits where the
    longer piece would have gone.
    """
    one, several, free = 1, 0, 0  # sums of the pieces as bits; several: of two or more of them
    for s, n in filling:
        for _ in range(n):
            several |= (several | one ^ 1) << s
            one |= one << s
    taken = dict(filling)
    for s, n in enumerate(counts):
        if n > taken.get(s, 0):
            free |= 1 << s
    return not several & free and not any(one << d & free for d in range(1, waste + 1))


def _reachable(room: int, counts: list[int]) -> tuple[list[int], list[int]]:
    """The lengths that fit into ``room``, longest first, and for each the sums (as bits) that it and all shorter ones can make."""
    sizes = [s for s in range(room, 0, -1) if counts[s]]
    whole, reach = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        sums, left, step = reach[-1], min(counts[s], room // s), 1
        while left:  # binary splitting of how many there are
            step = min(step, left)
            sums |= sums << s * step & whole
            left, step = left - step, 2 * step
        reach.append(sums)
    return sizes, reach[::-1]


def fillings(room: int, counts: list[int], most: int, tries: list[int], latest: list | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, pieces as (length, how many)) for the undominated fillings of ``room`` that waste ``most`` or less, least waste first.

    ``counts``: pieces by length. ``tries``: each filling that is tested for
    dominance takes one of its only entry; it ends at 0. Branch and bound over the lengths in
    descending order, the longest and as many of it as fit first. The bound is
    exact: for each length, the sums that it and all shorter ones can make.

    These take hundreds of KB, so of the iterators that share ``latest`` only
    the one that moved last keeps its own; another makes them anew. ``counts``
    may change between two steps, but is as it was whenever one is asked for.
    """
    latest, own = [None] if latest is None else latest, object()
    if counts[room] and room:
        yield 0, [(room, 1)]  # dominates all others
        return
    latest[:] = own, *_reachable(room, counts)
    for total in _bits(latest[2][0]):
        if (waste := room - total) > most:
            return
        stack: list[tuple[int, int, tuple]] = [(0, total, ())]
        while stack:
            if latest[0] is not own:
                latest[:] = own, *_reachable(room, counts)
            _, sizes, reach = latest
            at, left, chosen = stack.pop()
            while left and at < len(sizes):
                s = sizes[at]
                if s <= left:
                    rest = reach[at + 1]
                    fits = [n for n in range(min(left // s, counts[s]), -1, -1) if rest >> (left - n * s) & 1]
                    stack += [(at + 1, left - n * s, (*chosen, (s, n)) if n else chosen) for n in reversed(fits[1:])]
                    left -= fits[0] * s
                    chosen = (*chosen, (s, fits[0])) if fits[0] else chosen
                at += 1
            tries[0] -= 1
            sizes = reach = None
            if _undominated(list(chosen), counts, waste):
                yield waste, list(chosen)
            if tries[0] <= 0:
                return


def least_bins(counts: list[int]) -> int:
    """A lower bound of the bins for pieces of these lengths: those over half need one each, and what shorter ones add to the space that these leave."""
    capacity = len(counts) - 1
    n, size, half = np.array(counts, np.int64), np.arange(capacity + 1), capacity // 2
    over, total = np.cumsum(n[::-1])[::-1], np.cumsum((n * size)[::-1])[::-1]  # of this length or more
    over, total = np.append(over, 0), np.append(total, 0)
    k = np.arange(half + 1)  # pieces shorter than k are left out, and so are those that leave less than k
    top = capacity - k + 1
    beside = (over[half + 1] - over[top]) * capacity - (total[half + 1] - total[top])
    return int(over[half + 1] + max(0, (-(-(total[k] - total[half + 1] - beside) // capacity)).max()))


def best_fit(counts: list[int]) -> list[Pattern]:
    """Bins of the longest piece left and then, again and again, the longest that fits."""
    counts, plan, top = list(counts), [], len(counts) - 1
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return plan
        left, items = len(counts) - 1 - top, {top: 1}
        counts[top] -= 1
        for s in range(min(left, top), 0, -1):
            if n := min(left // s if s <= left else 0, counts[s]):
                items[s] = items.get(s, 0) + n
                left -= n * s
        counts[top] += 1
        copies = min(counts[s] // n for s, n in items.items())
        for s, n in items.items():
            counts[s] -= n * copies
        plan.append(Pattern(sorted(items.items(), reverse=True), copies))


def plan_bins(histogram: dict[int, int], capacity: int = 2048, nodes: int = NODES) -> list[Pattern]:
    """As few bins as bin completion finds for ``histogram`` (pieces by length).

    A depth-first branch and bound. A node takes the longest piece left and
    branches over the undominated fillings of the space beside it, each as
    often as the histogram allows, then half as often, down to once. Branches
    whose waste, or whose lower bound of bins, can't beat the incumbent are
    cut; the first incumbent is best fit. The first descent always ends (a
    room's first filling is undominated); ``nodes`` bounds how many branches
    and fillings are tried after it. Within that bound the plan has the fewest
    bins there are, and beyond it any incumbent is a valid packing. A plan has
    at most about capacity * (1 + ln capacity) patterns, however many pieces
    there are.
    """
    counts = [histogram.get(s, 0) for s in range(capacity + 1)]
    total, least = sum(s * n for s, n in enumerate(counts)), least_bins(counts)
    best = best_fit(counts)
    fewest, tries = sum(p.copies for p in best), [sys.maxsize]  # until the first descent has ended

    latest: list = [None]

    def branches(waste: int) -> Iterator[tuple[int, dict[int, int], int]]:
        top = next(s for s in range(capacity, 0, -1) if counts[s])
        counts[top] -= 1
        for lost, extra in fillings(capacity - top, counts, (fewest - 1) * capacity - total - waste, tries, latest):
            counts[top] += 1
            items = {top: 1}
            for s, n in extra:
                items[s] = items.get(s, 0) + n
            copies = min(counts[s] // n for s, n in items.items())
            while copies:
                yield lost, items, copies
                copies //= 2
            counts[top] -= 1
        counts[top] += 1

    # A level of the stack: bins and waste so far, the branches that remain; ``plan`` holds the branch taken at each, and ``counts``
    # what all of them leave: there are thousands of levels, so none has counts of its own.
    stack, plan = [(0, 0, branches(0) if total else iter(()))], []
    while stack and fewest > least and tries[0] > 0:
        bins, waste, rest = stack[-1]
        for p in plan[len(stack) - 1 :]:
            for s, n in p.items:
                counts[s] += n * p.copies
        del plan[len(stack) - 1 :]
        if (branch := next(rest, None)) is None:
            stack.pop()
            tries[0] = min(tries[0], nodes)
            continue
        lost, items, copies = branch
        if waste + lost * copies > (fewest - 1) * capacity - total:
            tries[0] = min(tries[0], nodes)
            continue
        tries[0] -= 1
        for s, n in items.items():
            counts[s] -= n * copies
        plan.append(Pattern(sorted(items.items(), reverse=True), copies))
        bins, waste = bins + copies, waste + lost * copies
        if not any(counts):
            best, fewest = list(plan), bins
            tries[0] = min(tries[0], nodes)
        elif bins + least_bins(counts) < fewest:
            stack.append((bins, waste, branches(waste)))
        else:
            tries[0] = min(tries[0], nodes)
    return best


@scoped
def pack_documents(df: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", nodes: int = NODES, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pack all documents of ``df`` into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Only documents longer than ``capacity`` are cut. Null
    and empty texts are a single id 0. Each input row is a document of its own,
    also where rows or ids repeat (null ids stay null); other columns are
    ignored; an empty table gives no rows. Ranks come from the written pieces,
    so a retried task repeats the same places. ``nodes`` bounds the driver's
    search (see ``plan_bins``); any bound gives a whole, valid packing.
    ``entries`` bounds a generation of a worker's word cache.
    """
    pieces = materialize(cut_pieces(df, path, capacity, doc_id, text, entries), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    starts, next_rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for p in plan_bins(histogram, capacity, nodes):
        offset = 0
        for s, n in p.items:
            starts.append((s, next_rank[s], n, sequence, offset))
            next_rank[s] += n * p.copies
            offset += s * n
        sequence += p.copies
    starts.sort()
    places = df.sparkSession.sparkContext.broadcast(np.array(starts, np.int64).reshape(-1, 5))  # a bounded number of patterns
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            row = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
