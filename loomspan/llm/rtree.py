"""An in-memory R-tree over count vectors, joined with itself or another under an overlap bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 16


class CountTree:
    """points: (m, groups) counts; sizes: their set sizes. The overlap of two sets is at most the sum, over the groups,
    of the smaller count, and for two boxes at most that of their upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.rows: list[np.ndarray] = []
        self.upper: list[np.ndarray] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.below: list[tuple[int, int] | None] = []
        self.root = self._pack(np.arange(len(sizes)))

    def _pack(self, rows: np.ndarray) -> int:
        """Packs rows into a node; halves by the set size or, if that is even, by the widest coordinate."""
        below = None
        if len(rows) > LEAF:
            some = self.points[rows]
            spread = np.ptp(some, axis=0)
            by = self.sizes[rows] if np.ptp(self.sizes[rows]) > 2 * spread.max() else some[:, spread.argmax()]
            order = np.argsort(by, kind="stable")
            half = len(rows) // 2
            below = (self._pack(rows[order[:half]]), self._pack(rows[order[half:]]))
        self.rows.append(rows)
        self.upper.append(self.points[rows].max(axis=0))
        self.least.append(int(self.sizes[rows].min()))
        self.most.append(int(self.sizes[rows].max()))
        self.below.append(below)
        return len(self.rows) - 1

    def join(self, other: CountTree, num: int, den: int, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose overlap bound allows a Jaccard similarity of num/den. skip(rows, rows) tells that a pair of
        nodes needs no look. A tree joined with itself gives each pair once."""
        need = lambda a, b: -(-(a + b) * num // (num + den))
        same = self is other
        stack = [(self.root, other.root)]
        while stack:
            a, b = stack.pop()
            if same and a == b and self.below[a]:
                x, y = self.below[a]
                stack += [(x, y), (y, y), (x, x)]
                continue
            if skip(self.rows[a], other.rows[b]):
                continue
            if not (same and a == b):
                bound = int(np.minimum(self.upper[a], other.upper[b]).sum())
                large, small = max(self.least[a], other.least[b]), min(self.most[a], other.most[b])
                if bound < need(self.least[a], other.least[b]) or den * small < num * large:
                    continue
            if self.below[a] and (not other.below[b] or len(self.rows[a]) >= len(other.rows[b])):
                stack += [(x, b) for x in self.below[a]]
            elif other.below[b]:
                stack += [(a, y) for y in other.below[b]]
            else:
                left, right = self.rows[a], other.rows[b]
                bound = np.minimum(self.points[left][:, None], other.points[right][None]).sum(-1)
                fits = bound >= need(self.sizes[left][:, None], other.sizes[right][None])
                if same and a == b:
                    fits &= np.triu(np.ones_like(fits), 1)
                i, j = np.nonzero(fits)
                if len(i):
                    yield left[i], right[j]
