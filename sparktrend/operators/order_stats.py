"""Order statistics of many windows at once, by a counting tree over ranks.

Values are numbered by rank. Each level of the tree splits them by a bit of
their rank, highest first, and keeps for each place how many before it went
left, and their sum. Selecting, counting and summing within a window then takes
one step a level, whatever the window's width; all windows take a step together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sparktrend.plans.params import Params

#: Windows that descend together: their state stays in cache.
TOGETHER = 65_536
#: The methods that a tree can answer.
METHODS = ("median", "trim_mean", "winsorize", "hampelfilt", "huber_psi")


class RankTree:
    """A tree over ``values``, none of them NaN. Memory: 12 bytes a value and level."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n, self.levels = n, max(1, (n - 1).bit_length())
        # Sums are of differences to the middle, which keeps their digits.
        self.middle = float(np.median(values)) if n else 0.0
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        self.distinct, self.first = np.unique(self.sorted, return_index=True)
        self.first = np.append(self.first, n)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        off = values - self.middle
        self.total = np.concatenate([[0.0], np.cumsum(off)])
        self.lefts, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            left = (rank >> level & 1) == 0
            self.lefts.append(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            self.sums.append(np.concatenate([[0.0], np.cumsum(np.where(left, off, 0.0))]))
            self.zeros.append(int(left.sum()))
            move = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            rank, off = rank[move], off[move]

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each window [low, high); k is within the window."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for left, zeros in zip(self.lefts, self.zeros, strict=True):
            a, b = left[low].astype(np.int64), left[high].astype(np.int64)
            right = k >= b - a
            k -= np.where(right, b - a, 0)
            low, high, rank = np.where(right, zeros + low - a, a), np.where(right, zeros + high - b, b), rank << 1 | right
        return self.sorted[rank]

    def sum_of_smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The sum of each window's k smallest values, less k times ``middle``."""
        start, end, whole, out = low.copy(), high.copy(), k >= high - low, np.zeros(len(low))
        k = k.copy()
        for left, sums, zeros in zip(self.lefts, self.sums, self.zeros, strict=True):
            a, b = left[start].astype(np.int64), left[end].astype(np.int64)
            right = k >= b - a
            out += np.where(right, sums[end] - sums[start], 0)
            k -= np.where(right, b - a, 0)
            start, end = np.where(right, zeros + start - a, a), np.where(right, zeros + end - b, b)
        return np.where(whole, self.total[high] - self.total[low], out)

    def below(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of each window's values have a smaller rank."""
        start, end, out = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, left, zeros in zip(range(self.levels - 1, -1, -1), self.lefts, self.zeros, strict=True):
            a, b = left[start].astype(np.int64), left[end].astype(np.int64)
            right = rank >> level & 1 == 1
            out += np.where(right, b - a, 0)
            start, end = np.where(right, zeros + start - a, a), np.where(right, zeros + end - b, b)
        return np.where(rank >= self.n, high - low, out)

    def border(self, guess: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """For each window the rank of the first value for which ``holds`` (values, windows), which holds from some value on; near ``guess``."""
        at = np.searchsorted(self.distinct, guess)
        every = np.arange(len(guess))
        for _ in range(3):  # rounding puts the guess off by a neighbour or two
            inside = at < len(self.distinct)
            at = at + (inside & ~holds(self.distinct[np.minimum(at, len(self.distinct) - 1)], every))
        for _ in range(3):
            at = at - ((at > 0) & holds(self.distinct[np.maximum(at - 1, 0)], every))
        return self.first[at]

    def median(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = high - low
        return (self.smallest(low, high, (n - 1) // 2) + self.smallest(low, high, n // 2)) / 2

    def deviation(self, low: np.ndarray, high: np.ndarray, center: np.ndarray) -> np.ndarray:
        """The median of the values' distances from each window's ``center``."""
        n = high - low
        lower = self.below(low, high, self.first[np.searchsorted(self.distinct, center)])  # values below the center, nearest last

        def nth(k: np.ndarray) -> np.ndarray:
            """The k-th smallest distance: how many of the k nearest lie below is found by bisection."""
            few, many = np.maximum(0, k - (n - lower)), np.minimum(k, lower)
            left = lambda i: center - self.smallest(low, high, np.clip(lower - 1 - i, 0, n - 1))
            right = lambda i: self.smallest(low, high, np.clip(lower + i, 0, n - 1)) - center
            while (open_ := few < many).any():
                i = (few + many) // 2
                # The i-th below is nearer than the last one above that it would replace.
                more = open_ & (left(i) < right(k - i - 1))
                few, many = np.where(more, i + 1, few), np.where(open_ & ~more, i, many)
            i = few
            far = np.inf
            return np.minimum(np.where(i < lower, left(i), far), np.where(k - i < n - lower, right(k - i), far))

        return (nth((n - 1) // 2) + nth(n // 2)) / 2


def estimates(tree: RankTree, low: np.ndarray, high: np.ndarray, p: Params) -> np.ndarray:
    """The estimate of each window [low, high), none of them empty, by one of ``METHODS``."""
    return np.concatenate([np.zeros(0), *(_some(tree, low[k : k + TOGETHER], high[k : k + TOGETHER], p) for k in range(0, len(low), TOGETHER))])


def _some(tree: RankTree, low: np.ndarray, high: np.ndarray, p: Params) -> np.ndarray:
    n, c = high - low, p.cval
    if p.method == "median":
        return tree.median(low, high)
    if p.method in ("trim_mean", "winsorize"):
        k = (n * c).astype(np.int64) + (p.method == "winsorize")
        inner = tree.sum_of_smallest(low, high, np.maximum(n - k, 0)) - tree.sum_of_smallest(low, high, np.minimum(k, n))
        if p.method == "trim_mean":
            return tree.middle + inner / (n - 2 * k)
        next_, last = (tree.smallest(low, high, np.clip(at, 0, n - 1)) for at in (k, n - k))
        filled = (k * (next_ - tree.middle) + inner + k * (last - tree.middle)) / n + tree.middle
        return np.where(n <= k, np.nan, np.where(n < 2 * k, next_, filled))
    m = tree.median(low, high)
    d = tree.deviation(low, high, m)
    reach = c * d
    strict = p.method == "hampelfilt"  # a value just as far off counts as an outlier
    begin = tree.border(m - reach, lambda x, i: (x >= m[i]) | (np.abs(x - m[i]) < reach[i]) if strict else (x >= m[i]) | (np.abs(x - m[i]) <= reach[i]))
    end = tree.border(m + reach, lambda x, i: (x > m[i]) & ((np.abs(x - m[i]) >= reach[i]) if strict else (np.abs(x - m[i]) > reach[i])))
    below, upto = tree.below(low, high, begin), tree.below(low, high, end)
    upto = np.maximum(upto, below)
    inner = tree.sum_of_smallest(low, high, upto) - tree.sum_of_smallest(low, high, below) - (upto - below) * (m - tree.middle)
    if strict:
        # Without spread all values are outliers, and the center stands for each.
        return np.where(reach > 0, m + inner / n, m)
    return np.where(d > 0, m + (inner + reach * ((n - upto) - below)) / n, np.nan)
