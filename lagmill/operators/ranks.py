"""Order statistics of many ranges of one column at once."""

from __future__ import annotations

import numpy as np


class RankIndex:
    """Exact order statistics of any ranges of ``values``, all ranges together in one pass over the bits of a rank.

    Values are replaced by their ranks. Level by level the sequence is parted, in order, into ranks whose bit is zero and the
    rest, with running counts of the zeros: counts of a range of positions at one level give the same range at the next. So a
    series of n rows is sorted once, and the quantiles of all its expanding windows cost n log n instead of a sort each.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()) if len(values) else 0)):
            zero = ((ranks >> bit) & 1) == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)])))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of rows start..end-1, for arrays of ranges that hold more than k rows."""
        start, end, k = (np.array(x, np.int64) for x in (start, end, k))
        rank = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            low, high = zeros[start], zeros[end]
            upper = k >= high - low
            rank += upper.astype(np.int64) << bit
            k = np.where(upper, k - (high - low), k)
            start, end = np.where(upper, zeros[-1] + start - low, low), np.where(upper, zeros[-1] + end - high, high)
        return self.sorted[rank]

    def quantile(self, start: np.ndarray, end: np.ndarray, p: float, low=-np.inf, high=np.inf) -> np.ndarray:
        """Quantile of each range, interpolated linearly between two ranks, after its rows were clipped to low..high.

        Clipping keeps the order, so the order statistics of clipped rows are clipped order statistics."""
        place = (np.asarray(end) - np.asarray(start) - 1) * p
        below = np.floor(place).astype(np.int64)
        part = place - below
        above = np.minimum(below + 1, np.asarray(end) - np.asarray(start) - 1)
        a, b = (np.clip(self.kth(start, end, k), low, high) for k in (below, above))
        # As numpy interpolates: from the nearer side.
        return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))
