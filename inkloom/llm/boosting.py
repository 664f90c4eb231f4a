"""Gradient-boosted trees for small tabular problems, fitted on the driver and sent to the workers as plain numbers."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting over shallow trees.

    ``fit`` takes a bounded sample; ``score`` gives probabilities.  Fitting is
    deterministic.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.start, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        at = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-at))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.model.append(tree)
            at += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, gradient, weight, rows, cuts, depth):
        total_g, total_h = gradient[rows].sum(), weight[rows].sum()
        leaf = float(total_g / (total_h + 1.0))
        if depth == 0 or len(rows) < 8:
            return leaf
        best, choice = 1e-6, None
        base = total_g**2 / (total_h + 1.0)
        for j, points in enumerate(cuts):
            if not len(points):
                continue
            where = np.searchsorted(points, x[rows, j], side="right")
            g = np.cumsum(np.bincount(where, gradient[rows], len(points) + 1))[:-1]
            h = np.cumsum(np.bincount(where, weight[rows], len(points) + 1))[:-1]
            gain = g**2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - base
            k = int(gain.argmax())
            if gain[k] > best:
                best, choice = gain[k], (j, float(points[k]))
        if choice is None:
            return leaf
        low = x[rows, choice[0]] < choice[1]
        if low.all() or not low.any():
            return leaf
        return (*choice, self._grow(x, gradient, weight, rows[low], cuts, depth - 1), self._grow(x, gradient, weight, rows[~low], cuts, depth - 1))

    def _walk(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, point, low, high = tree
        under = x[:, j] < point
        out = np.empty(len(x))
        out[under], out[~under] = self._walk(low, x[under]), self._walk(high, x[~under])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        at = np.full(len(x), self.start)
        for tree in self.model:
            at += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-at))
