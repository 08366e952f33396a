"""Bin packing on balanced trees: best-fit decreasing and first-fit decreasing.

Small helpers run inside tasks, on one bounded group of items at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np


class RemainingTree:
    """Bins ordered by remaining capacity: a two-level B-tree of (remaining, bin) pairs.

    Leaves split at ``LEAF`` pairs, so a lookup is two binary searches."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.lows: list[tuple[int, int]] = [(-1, -1)]     # the first pair a leaf may hold

    def _leaf(self, pair: tuple[int, int]) -> int:
        return max(bisect_right(self.lows, pair) - 1, 0)

    def add(self, remaining: int, number: int) -> None:
        at = self._leaf((remaining, number))
        leaf = self.leaves[at]
        insort(leaf, (remaining, number))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.lows.insert(at + 1, leaf[half])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the pair of least remaining capacity that holds ``size``."""
        at = self._leaf((size, -1))
        for i in range(at, len(self.leaves)):
            leaf = self.leaves[i]
            j = bisect_left(leaf, (size, -1))
            if j < len(leaf):
                return self._pop(i, j)
        return None

    def take_emptiest(self) -> tuple[int, int] | None:
        """Remove and return the pair of most remaining capacity."""
        for i in range(len(self.leaves) - 1, -1, -1):
            if self.leaves[i]:
                return self._pop(i, len(self.leaves[i]) - 1)
        return None

    def _pop(self, i: int, j: int) -> tuple[int, int]:
        pair = self.leaves[i].pop(j)
        if not self.leaves[i] and len(self.leaves) > 1:
            del self.leaves[i], self.lows[i]
            self.lows[0] = (-1, -1)
        return pair


def best_fit_decreasing(sizes: np.ndarray, capacity: int, max_bins: int | None = None) -> np.ndarray:
    """Bin of each item; items go by falling size into the tightest bin that holds them.

    An item above the capacity gets a bin of its own. With ``max_bins``, an
    item that fits no bin once that many are open goes to the emptiest."""
    out = np.zeros(len(sizes), np.int64)
    tree, bins = RemainingTree(), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        pair = tree.take_tightest(size)
        if pair is None and (max_bins is None or bins < max_bins):
            pair, bins = (capacity, bins), bins + 1
        elif pair is None:
            pair = tree.take_emptiest()
        out[i] = pair[1]
        tree.add(pair[0] - size, pair[1])
    return out


class CapacityTournament:
    """A tournament tree over bins in opening order: each node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(bins - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin that holds it and return the bin."""
        best, node = self.best, 1
        while node < self.base:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        leaf, node = node - self.base, node // 2
        while node:
            best[node] = max(best[2 * node], best[2 * node + 1])
            node //= 2
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, by falling size into the first bin that holds it; no item exceeds the capacity."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int(np.count_nonzero(sizes == capacity))          # each fills a bin alone
    out[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    tree = CapacityTournament(max(len(rest), 1), capacity)
    for i in rest:
        out[i] = full + tree.place(int(sizes[i]))
    return out
