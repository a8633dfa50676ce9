"""Gradient-boosted regression trees for a yes/no target, with histogram splits, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth; a node tests ``feature <= threshold``."""

    def __init__(self, depth: int = 4, trees: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.depth, self.n_trees, self.rate, self.bins, self.ridge = depth, trees, rate, bins, ridge
        self.base, self.features, self.thresholds, self.leaves = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
        share = np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                cut = np.full(width, self.bins)
                for k in range(f):
                    at = node * self.bins + binned[:, k]
                    gs, hs = (np.bincount(at, v, width * self.bins).reshape(width, -1).cumsum(1) for v in (g, h))
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[:, len(edges[k]) :] = 0
                    top = gain.argmax(1)
                    won = gain[np.arange(width), top] > best
                    best[won], cut[won] = gain[np.arange(width), top][won], top[won]
                    feature[first : first + width][won] = k
                    threshold[first : first + width][won] = edges[k][np.minimum(top[won], len(edges[k]) - 1)] if len(edges[k]) else np.inf
                node = 2 * node + (binned[np.arange(n), feature[first + node]] > cut[node])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * gs / (hs + self.ridge)
            margin += leaf[node]
            self.features.append(feature)
            self.thresholds.append(threshold)
            self.leaves.append(leaf)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > threshold[at])
            out += leaf[node]
        return out
