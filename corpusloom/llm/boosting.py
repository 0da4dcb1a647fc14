"""Gradient boosting of small regression trees on the logistic loss, in numpy; for a few ten thousand rows of few features."""

from __future__ import annotations

import numpy as np


def _quantised(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _best_split(q: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, bins: int, ridge: float):
    """(gain, feature, bin): rows with q <= bin go left."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-9, -1, 0)
    for j in range(q.shape[1]):
        sg = np.cumsum(np.bincount(q[rows, j], g[rows], bins))[:-1]
        sh = np.cumsum(np.bincount(q[rows, j], h[rows], bins))[:-1]
        gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    return best


class BoostedTrees:
    """Trees of depth `depth`; a node is (feature, threshold, left, right) or a number."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 5.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.base, self.trees, self.slope, self.shift = 0.0, [], 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        q = _quantised(x, edges)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)

            def grow(rows, depth):
                gain, j, k = _best_split(q, g, h, rows, self.bins, self.ridge) if depth and len(rows) > 10 else (0, -1, 0)
                if j < 0:
                    value = float(g[rows].sum() / (h[rows].sum() + self.ridge) * self.rate)
                    score[rows] += value
                    return value
                left = q[rows, j] <= k
                return (j, float(edges[j][min(k, len(edges[j]) - 1)]), grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

            self.trees.append(grow(np.arange(len(y)), self.depth))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def walk(node, rows):
            if isinstance(node, tuple):
                left = x[rows, node[0]] <= node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])
            else:
                out[rows] += node

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that the trees haven't seen."""
        s, a, b = self.raw(x), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * s + b)))
            a -= 0.5 * float(np.mean((p - y) * s)) / (1 + float(np.mean(s * s)))
            b -= 0.5 * float(np.mean(p - y))
        self.slope, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
