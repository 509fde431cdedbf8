"""Gradient-boosted trees for binary labels, with histogram splits in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth: split features and thresholds by heap position, leaf values; log odds are their sum."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base
        self.depth = int(np.log2(leaf.shape[1]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 48, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss; candidate thresholds are quantiles of a feature's distinct values."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins)))[:-1] for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # v > cut k exactly if code > k
    size = bins + 1
    flat = code + np.arange(width) * size
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            place = (local[:, None] * (width * size) + flat).ravel()
            gs = np.bincount(place, np.repeat(g, width), nodes * width * size).reshape(nodes, width, size).cumsum(axis=2)
            hs = np.bincount(place, np.repeat(h, width), nodes * width * size).reshape(nodes, width, size).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1e-2) | (ht - hs < 1e-2)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, c = divmod(int(best[k]), size)
                if gain[k, f, c] > 1e-6 and c < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][c]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        local = at - inner
        value = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + ridge)
        score += value[local]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(values), base)
