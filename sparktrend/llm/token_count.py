"""Token counts by the whole-token shortcut.

A sentencepiece BPE vocabulary whose pieces never hold the space mark behind
another character cannot merge across "space run + word" borders, so a text's
count is the sum over those pre-tokens. Offline, the driver proves for each
vocabulary string whether it encodes alone as one token; those pre-tokens
count as 1 by a set lookup, and only the others are merged by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import fresh, small_batches

MARK = "▁"
#: Entries of a worker's count cache before it starts anew (a memory bound; counts don't depend on it).
CACHE_ENTRIES = 400_000
_PRETOKEN = re.compile(r" +[^ ]*")
_models: dict[str, _Counts] = {}


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove_single_tokens(path: str) -> frozenset[str]:
    """Words that the model at ``path`` encodes, after a space or at the start, as exactly one token.

    Each vocabulary string of the form "space mark + word" is encoded once by
    the library itself; the answer is a proof, not a guess from the vocabulary.
    Raises ValueError for a vocabulary in which pre-tokens aren't independent.
    """
    model = _processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if bad := [p for p in pieces if MARK in p.lstrip(MARK)]:
        raise ValueError(f"pieces with an inner space mark: {bad[:3]}")
    if model.encode("a b") != model.encode("a") + model.encode("b"):
        raise ValueError("the model doesn't keep words apart, or adds no space before the first")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class _Counts(dict):
    """Token counts by pre-token (without its first space), filled on demand."""

    def __init__(self, path: str):
        self.encode = _processor(path).encode

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self[word] = len(self.encode(word)) if word else 1  # a space mark alone
        return n


def count_text(text: str, single: frozenset[str], counts: _Counts) -> int:
    if not text:
        return 0
    if MARK in text:
        text = text.replace(MARK, " ")  # the library sees both as the same symbol
    words = text.split(" ") if "  " not in text and text[0] != " " else [p[1:] for p in _PRETOKEN.findall(" " + text)]
    rest = [w for w in words if w not in single]
    return len(words) - len(rest) + sum(map(counts.__getitem__, rest))


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` without ``text``, and with n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 bytes, 0 tokens). One output row for each
    input row, repeated rows included; no shuffle. Columns of ``df`` with the
    new names (in any case) are replaced. ``path``: the .model file, on every
    executor. Memory: one Arrow batch and a bounded cache per worker.
    """
    df = small_batches(df)
    single = df.sparkSession.sparkContext.broadcast(prove_single_tokens(path))  # bounded by the vocabulary
    new = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in df.columns if c != text and c.lower() not in new]
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh("__text", keep)))
    kept = base.schema[: len(keep)] if keep else None
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = _Counts(path)
        known, counts = single.value, _models[path]
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = [count_text(t.as_py(), known, counts) for t in texts]
            n_bytes = pa.compute.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            tokens = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n_bytes, tokens, pa.compute.greater(tokens, limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return base.mapInArrow(run, ", ".join([*fields, "n_bytes long", "n_tokens long", "over_limit boolean"]))
