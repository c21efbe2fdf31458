"""Gradient-boosted trees for two classes, small enough to train on a bounded sample.

Features are cut into at most 32 quantile bins; a tree grows level by level, every node
split where the second-order gain is greatest; trees are complete, so a batch is scored by
as many indexing steps as a tree is deep."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): to the right if value > threshold
    leaf: np.ndarray  # (trees, leaves): log odds to add
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x).clip(-35, 35)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Trees for labels ``y`` (0 or 1) of rows ``x``; both classes must occur."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.average(y, weights=weight)
    start = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, start), (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, size = (1 << level) - 1, 1 << level
            gain = np.zeros(size)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = len(c) + 1
                key = (node - first) * bins + binned[:, j]
                gs = np.bincount(key, g, size * bins).reshape(size, bins).cumsum(axis=1)
                hs = np.bincount(key, h, size * bins).reshape(size, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                value[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                at = value[:, :-1].argmax(axis=1)
                best = value[np.arange(size), at]
                better = best > gain + 1e-12
                gain[better] = best[better]
                feature[first : first + size][better] = j
                threshold[first : first + size][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gs / (hs + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), start)
