"""Gradient-boosted trees for binary labels, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: a feature and cut for each inner node, a value for each leaf."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row."""
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss; ties go to the first feature and cut."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    p = float((weight * y).sum() / weight.sum())
    start = float(np.log(p / (1 - p)))
    score = np.full(len(x), start)
    inner = (1 << depth) - 1
    features, limits, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = weight * (prob - y), weight * prob * (1 - prob)
        at = np.zeros(len(x), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.nonzero(at == node)[0]
            best = 1e-6
            g, h = grad[mine].sum(), hess[mine].sum()
            for k, c in enumerate(cuts):
                if not len(mine) or not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[mine, k], grad[mine], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[mine, k], hess[mine], len(c) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                b = int(np.argmax(gain))
                if gain[b] > best:
                    best, feature[node], limit[node] = gain[b], k, c[b]
            at[mine] = 2 * node + 1 + (x[mine, feature[node]] > limit[node])
        slot = at - inner
        g, h = np.bincount(slot, grad, inner + 1), np.bincount(slot, hess, inner + 1)
        value = -rate * g / (h + ridge)
        score += value[slot]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Boosted(np.array(features), np.array(limits), np.array(leaves), start)
