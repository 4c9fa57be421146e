"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k): one weight vector for all ordered
thresholds. x holds log(1 + count) of words and word beginnings (4 to 6
letters, so that inflected forms share a feature) from a vocabulary that the
labelled sample itself selects. The labels say only whether a text is toxic,
so toxic training texts are graded 1 to 3 by how sure of it a model of the
other half of the sample is (see ``grade_sample``). Scores are P(grade >= 1) and the
expected severity, the sum of P(grade >= k).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import labelled_texts, materialize, scoped, small_batches

#: Most labelled rows that a fit reads (the first by a hash of doc_id).
SAMPLE_ROWS = 12_000
#: Defaults of a fit's features: the most there are, the texts of the sample that a feature must be in, and the least
#: log likelihood ratio between its toxic and clean rates (chance alone reaches 8 about once in 16,000 features).
VOCABULARY, LEAST_TEXTS, LEAST_GAIN = 256, 5, 8.0
STEMS = (4, 5, 6)
#: Entries of a worker's word cache before it starts anew (a memory bound; scores don't depend on it).
CACHE_ENTRIES = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_features(word: str) -> tuple[str, ...]:
    """The word itself, and its beginnings marked by a star."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) >= n))


class _Known(dict):
    """The vocabulary features of a word, filled on demand."""

    def __init__(self, features: frozenset[str]):
        self.features = features

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = tuple(f for f in word_features(word) if f in self.features)
        return found


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    cutoff: float = 0.5

    def scorer(self):
        """text -> w . x"""
        known = _Known(frozenset(self.weights))

        def latent(text: str) -> float:
            n = Counter(f for found in filter(None, map(known.__getitem__, text_words(text))) for f in found)
            return float(sum(self.weights[f] * np.log1p(n[f]) for f in sorted(n)))

        return latent

    def grades(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return _sigmoid(np.asarray(latent, float)[:, None] - np.array(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _likelihood(p: np.ndarray, x: np.ndarray, grade: np.ndarray, levels: int, penalty: float) -> tuple[float, np.ndarray]:
    """The penalised negative log likelihood a row, and its gradient. ``p``: weights, theta_1, logs of the thresholds' increments."""
    n, width = x.shape
    w, theta = p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
    cum = np.hstack([np.ones((n, 1)), _sigmoid((x @ w)[:, None] - theta), np.zeros((n, 1))])
    rows = np.arange(n)
    prob = np.maximum(cum[rows, grade] - cum[rows, grade + 1], 1e-12)
    slope = cum * (1 - cum)
    low, high = slope[rows, grade] / prob, slope[rows, grade + 1] / prob
    g_theta = np.array([low[grade == k].sum() - high[grade == k - 1].sum() for k in range(1, levels)])
    g = np.concatenate([penalty * w - x.T @ (low - high), [g_theta.sum()], [g_theta[k:].sum() * np.exp(p[width + k]) for k in range(1, levels - 1)]])
    return (-np.log(prob).sum() + penalty * (w @ w) / 2) / n, g / n


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, levels: int, penalty: float = 2.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood (limited-memory BFGS until the gradient is at most 1e-6).

    thresholds are theta_1 and positive increments, so they can't cross.
    """
    x = np.asarray(x, float)
    width = x.shape[1]
    share = np.clip([(grade >= k).mean() for k in range(1, levels)], 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(levels - 1) * 1e-3)
    p = np.concatenate([np.zeros(width), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    cost, g = _likelihood(p, x, grade, levels, penalty)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= 1e-6:
            break
        d, kept = -g, []
        for s, y in reversed(pairs):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if pairs else min(1.0, 1 / np.abs(g).sum())
        while step > 1e-10:
            new_cost, new_g = _likelihood(p + step * d, x, grade, levels, penalty)
            if new_cost <= cost + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (step * d) @ (new_g - g) > 1e-14:
            pairs = [*pairs[-9:], (step * d, new_g - g)]
        p, cost, g = p + step * d, new_cost, new_g
    return p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))


def grade_sample(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of the sample: 0 for clean rows; toxic ones 1, 2 or 3.

    The labels only say whether a text is toxic, so the severity of a toxic
    text is how sure of it a model is that was fitted on the other half of the
    sample: grade 1 up to the median, 2 up to the 85th percentile, else 3.
    """
    sure = np.zeros(len(toxic))
    half = np.arange(len(toxic)) % 2 == 0
    for fold in (half, ~half):
        w, _ = fit_cumulative_link(x[~fold], toxic[~fold].astype(int), 2)
        sure[fold] = x[fold] @ w
    if not toxic.any():
        return np.zeros(len(toxic), int)
    middle, high = np.quantile(sure[toxic], [0.5, 0.85])
    return np.where(toxic, 1 + (sure > middle) + (sure > high), 0).astype(int)


def best_cutoff(p: np.ndarray, toxic: np.ndarray) -> float:
    """The p_toxic that parts the sample with the fewest errors: the middle, on the logit scale, of the best gap; at most 0.5."""
    order = np.argsort(p, kind="stable")
    p, y = np.clip(p[order], 1e-6, 1 - 1e-6), toxic[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((~y)[::-1])[::-1], [0]])
    k = int(errors.argmin())
    if k in (0, len(p)):
        return 0.5
    logit = np.log(p[k - 1 : k + 1] / (1 - p[k - 1 : k + 1])).mean()
    return float(min(0.5, 1 / (1 + np.exp(-logit))))


@scoped
def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, least_texts: int = LEAST_TEXTS, least_gain: float = LEAST_GAIN) -> OrdinalModel:
    """Fit on at most ``rows`` labelled rows, chosen by a hash of their id. An id that repeats among ``docs`` gives one text.

    Features are the ``vocabulary`` words and word beginnings, of those in
    ``least_texts`` texts of the sample or more, whose toxic and clean rates
    differ most surely, by a log likelihood ratio of ``least_gain`` at least:
    others would only add noise, which long texts add up.

    Rows with a null label or id are not used; a label for a missing document
    has no effect; without any usable row or vocabulary the model is constant.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(f for w in text_words(t.as_py() or "") for f in word_features(w)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["y", "words", "counts"])

    def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()  # the sample is bounded, so is this
        for batch in batches:
            for y, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have.update((y, w) for w in found)
        keys = list(have)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([have[k] for k in keys], pa.int64())], names=["y", "word", "n"])

    kept = small_batches(labelled_texts(docs, chosen, doc_id, text).select("y", "text"))  # at most ``rows`` rows
    sample = materialize(kept.mapInArrow(words, "y int, words array<string>, counts array<int>"), "toxic-sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel({}, (40.0,) if not n1 else (-40.0,))
    by_word = sample.select("y", "words").mapInArrow(texts_with, "y int, word string, n long").groupBy("word").agg(F.sum(F.col("n") * F.col("y")).alias("k1"), F.sum(F.col("n") * (1 - F.col("y"))).alias("k0"))
    n, base = (F.col("k1") + F.col("k0")).cast("double"), n1 / (n1 + n0)
    rate = (F.col("k1") + 0.5 * base) / (n + 0.5)
    gain = n * (rate * F.log(rate / base) + (1 - rate) * F.log((1 - rate) / (1 - base)))  # a G statistic: how surely the rates differ
    ranked = by_word.filter(n >= least_texts).select("word", rate.alias("rate"), F.round(gain, 6).alias("gain")).filter(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "word").limit(vocabulary).collect()
    place = {r["word"]: i for i, r in enumerate(ranked)}
    if not place:
        share = np.log(n0 / n1)
        return OrdinalModel({}, (float(share),))
    hits = F.filter(F.arrays_zip("words", "counts"), lambda w: w["words"].isin(list(place)))
    rows_ = sample.select("y", hits.alias("hits")).collect()  # at most ``rows`` rows of vocabulary words
    counts, toxic = np.zeros((len(rows_), len(place)), np.float32), np.array([r["y"] == 1 for r in rows_])
    for i, r in enumerate(rows_):
        for h in r["hits"]:
            counts[i, place[h["words"]]] = h["counts"]
    order = np.lexsort(counts.T[::-1])  # the collected order may vary, sums then would in their last bits
    order = order[np.argsort(toxic[order], kind="stable")]
    counts, toxic = counts[order], toxic[order]
    w, theta = fit_cumulative_link(np.log1p(counts), grade_sample(np.log1p(counts), toxic), 4)
    return OrdinalModel({word: float(w[i]) for word, i in place.items() if w[i]}, tuple(map(float, theta)), best_cutoff(_sigmoid(np.log1p(counts) @ w - theta[0]), toxic))


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_toxic, expected_severity, severity (likeliest grade), toxic (1 if p_toxic reaches the model's cutoff).

    One row for each row of ``docs``, repeated ones and null ids included;
    null texts are empty; texts of any length are read whole; other columns,
    whatever their names, are ignored; an empty table gives no rows; no shuffle.
    """
    docs = small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the vocabulary
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        latent = m.scorer()
        for batch in batches:
            above = m.grades(np.array([latent(t.as_py() or "") for t in batch.column(1)]))
            each = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((above[:, 0] >= m.cutoff).astype(np.int32))], names=["doc_id", "p_toxic", "expected_severity", "severity", "toxic"])

    return base.mapInArrow(run, f"doc_id {base.schema[0].dataType.simpleString()}, p_toxic double, expected_severity double, severity int, toxic int")
