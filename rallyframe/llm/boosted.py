"""Small gradient-boosted trees on histograms, for node features inside tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary logistic boosting with complete trees of one depth over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.features = np.zeros((0, 0), dtype=np.int64)
        self.cuts = np.zeros((0, 0))
        self.leaves = np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        width = self.bins
        offset = np.arange(m) * width
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        score = np.full(n, self.base)
        features, cuts, leaves = [], [], []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-9
            node = np.zeros(n, dtype=np.int64)
            own_f, own_c = [], []
            for level in range(self.depth):
                size = 1 << level
                cell = (node[:, None] * (m * width) + offset[None, :] + binned).ravel()
                g = np.bincount(cell, weights=np.repeat(grad, m), minlength=size * m * width).reshape(size, m, width).cumsum(axis=2)
                h = np.bincount(cell, weights=np.repeat(hess, m), minlength=size * m * width).reshape(size, m, width).cumsum(axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(size, -1).argmax(axis=1)
                f, c = best // width, best % width
                own_f.append(f)
                own_c.append(np.array([self.edges[a][b] if b < len(self.edges[a]) else np.inf for a, b in zip(f, c, strict=True)]))
                node = 2 * node + (binned[np.arange(n), f[node]] > c[node])
            size = 1 << self.depth
            value = np.bincount(node, weights=grad, minlength=size) / (np.bincount(node, weights=hess, minlength=size) + self.ridge)
            score = score + self.rate * value[node]
            features.append(np.concatenate(own_f))
            cuts.append(np.concatenate(own_c))
            leaves.append(self.rate * value)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[row, f[at]] > c[at])
            out += leaf[node]
        return out
