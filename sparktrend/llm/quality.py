"""Quality classifier: a sparse rule ensemble.

Small boosted trees over text statistics are fitted on a bounded labelled
sample; every path from a root becomes a conjunctive rule; lasso logistic
regression keeps few of them; and the kept rules compile into one Spark column
expression, so that scoring is a projection without Python or a shuffle.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import WORD, labelled_texts

#: Most labelled rows that a fit reads (the first by a hash of doc_id).
SAMPLE_ROWS = 20_000
TREES, DEPTH, CUTS = 30, 3, 48


#: Names of the statistics, in the order of ``statistics``' array.
NAMES = ("log_words", "word_length", "upper", "digits", "stops", "signs", "short", "repeats", "distinct_words", "distinct_lines", "words_a_line", "others")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistics(text: Column) -> Column:
    """An array of a text's statistics (null: empty), finite doubles in the order of ``NAMES``."""

    def measured(s: Column) -> Column:
        t, n, w, lines = s["t"], s["n"], s["w"], s["lines"]
        count = lambda pattern: F.regexp_count(t, F.lit(pattern))
        values = {
            "log_words": F.log1p(w),
            "word_length": n / w,
            "upper": count(r"\p{Lu}") / n,
            "digits": count(r"[0-9]") / n,
            "stops": count(r"[.,;:?]") / w,
            "signs": count(r"[!#$%&*|@^~<>=+\\{}\[\]]") / w,
            "short": count(r"(?<!\S)\p{L}{1,3}(?!\S)") / w,
            "repeats": count(r"(?<!\S)(\S++)(?= \1(?!\S))") / w,
            "distinct_words": F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+", -1))) / w,
            "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
            "words_a_line": F.log1p(w / F.size(lines)),
            "others": count(r"[^\p{L}\p{N}\p{P}\s]") / n,
        }
        return F.array(*[values[name].cast("double") for name in NAMES])

    sized = lambda t: F.struct(t.alias("t"), F.greatest(F.length(t), F.lit(1)).cast("double").alias("n"), F.greatest(F.regexp_count(t, F.lit(WORD)), F.lit(1)).cast("double").alias("w"), F.split(t, "\n", -1).alias("lines"))
    return _let(_let(F.coalesce(text, F.lit("")), sized), measured)


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + sum of weights of the rules that hold). A rule: ((statistic, is_above, cut), ...)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def column(self, stats: Column) -> Column:
        """The score as a column of ``statistics``."""
        if not self.rules:
            return F.lit(1 / (1 + float(np.exp(-self.bias))))

        def total(s: Column) -> Column:
            out = F.lit(self.bias)
            for conditions, weight in self.rules:
                values = [(s[NAMES.index(name)], above, cut) for name, above, cut in conditions]
                holds = functools.reduce(operator.and_, [v > cut if above else v <= cut for v, above, cut in values])
                out = out + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-out))

        return _let(stats, total)


def grow_tree(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int = DEPTH, least: int = 20) -> list:
    """A regression tree on the gradients: nested [feature, cut, low, high] or a leaf value."""

    def grow(rows: np.ndarray, left: int):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = np.searchsorted(c, x[rows, f], "left")  # values <= c[k] are in bins 0..k
                gl, hl, nl = (np.cumsum(np.bincount(bins, v, len(c) + 1))[:-1] for v in (gradient[rows], hessian[rows], None))
                ok = (nl >= least) & (len(rows) - nl >= least)
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, c[k])
        if best[1] is None:
            return -g / (h + 1)
        low = x[rows, best[1]] <= best[2]
        return [best[1], float(best[2]), grow(rows[low], left - 1), grow(rows[~low], left - 1)]

    return grow(np.arange(len(x)), depth)


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], tree_values(tree[2], x), tree_values(tree[3], x))


def tree_rules(tree, path: tuple = ()) -> list[tuple]:
    """Every path from the root to a node below it."""
    if not isinstance(tree, list):
        return []
    out = []
    for above, child in ((False, tree[2]), (True, tree[3])):
        step = (*path, (tree[0], above, tree[1]))
        out += [step, *tree_rules(child, step)]
    return out


def rule_holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([x[:, f] > c if above else x[:, f] <= c for f, above, c in rule])


def steepness(z: np.ndarray) -> float:
    """A bound of the largest eigenvalue of the rows' products, with a column of ones (power iteration, and a margin)."""
    a, v = np.hstack([np.ones((len(z), 1)), z]), np.ones(z.shape[1] + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    return max(float(v @ (a.T @ (a @ v))), 1e-9) / 0.95


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 1000) -> np.ndarray:
    """Bias and weights that minimise the mean logistic loss + penalty * sum |w|.

    Accelerated proximal gradient steps on the columns whose weight isn't 0 in
    ``start``, until none moves by 1e-5; then columns whose slope exceeds the
    penalty join, until there are none.
    """
    n, width = z.shape
    w = np.zeros(width + 1) if start is None else start.copy()
    active = w[1:] != 0
    while True:
        a = np.hstack([np.ones((n, 1)), z[:, active]])
        step, at = 4 * n / steepness(z[:, active]), np.append(True, active)
        v = u = w[at]
        t = 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ u, -40, 40)))
            new = u - step * (a.T @ (p - y) / n)
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
            if (u - new) @ (new - v) > 0:  # the momentum points back: start it anew
                t = 1.0
            moved = np.abs(new - v).max()
            t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            u, v = new + (old - 1) / t * (new - v), new
            if moved < 1e-5:
                break
        w[at] = v
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        beyond = ~active & (np.abs(z.T @ (p - y) / n) > penalty * (1 + 1e-3))
        if not beyond.any():
            return w
        active |= beyond


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = (0.01, 0.004, 0.0015, 0.0006)) -> RuleModel:
    """Boost trees, extract rules, and fit lasso weights; the penalty is chosen on every fifth row."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else 4.0 * (2 * float(y[0]) - 1), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    rng, logit, rules = np.random.default_rng(5), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        part = rng.random(len(y)) < 0.7
        tree = grow_tree(x[part], cuts, (p - y)[part], (p * (1 - p))[part])
        logit += 0.2 * tree_values(tree, x)
        for r in tree_rules(tree):
            rules.setdefault(rule_holds(r, x).tobytes(), r)
    kept = [(r, h) for r in rules.values() if 0 < (h := rule_holds(r, x)).sum() < len(y)]
    if not kept:
        return RuleModel(float(logit[0]), ())
    z = np.stack([h for _, h in kept], 1).astype(float)
    test = np.arange(len(y)) % 5 == 4

    best, w = None, None
    for penalty in sorted(penalties, reverse=True):  # each from the sparser one before
        w = lasso_logistic(z[~test], y[~test], penalty, w)
        q = np.clip(1 / (1 + np.exp(-np.clip(w[0] + z[test] @ w[1:], -40, 40))), 1e-6, 1 - 1e-6)
        loss = -(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)).mean() if test.any() else 0.0
        if best is None or loss < best[0]:
            best = (loss, penalty, w)
    w = lasso_logistic(z, y, best[1], best[2])
    return RuleModel(float(w[0]), tuple((tuple((names[f], above, float(c)) for f, above, c in r), float(k)) for (r, _), k in zip(kept, w[1:], strict=True) if k))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``rows`` labelled rows, chosen by a hash of their id, none of them held out. An id that repeats among ``docs`` gives one text.

    Rows with a null label or id are not used. Without usable rows the model
    gives 0.5 everywhere.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = usable.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    got = labelled_texts(docs, chosen, doc_id, text).select("id", "y", statistics(F.col("text")).alias("stats")).toPandas()
    x = np.array(got["stats"].tolist(), float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T[::-1], got["y"], got["id"]))  # the collected order may vary
    return fit_rules(list(NAMES), x[order], got["y"].to_numpy(float)[order])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the chance of label 1, from 0 to 1 (null texts: as empty ones).

    Keeps every row and other column, whatever its name, repeated rows and null
    ids included; a column ``name`` of ``docs`` is replaced; texts of any length
    are read whole; an empty table gives no rows; no shuffle.
    """
    return docs.withColumn(name, model.column(statistics(F.col(f"`{text}`"))))
