"""Gradient-boosted regression trees for one yes-or-no question, on arrays."""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Boosted:
    """Complete binary trees of one depth; node k has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        score = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int32)
            while len(rows) and node[0] < inner:
                node = 2 * node + 1 + (rows[at_row, feature[node]] > cut[node])
            score += leaf[node - inner]
        return score


def fit(rows: np.ndarray, truth: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, prior: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss; splits are searched over quantiles of every feature."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    coded = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], 1)
    slots = bins + 1
    share = float(np.clip(truth.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    flat = coded + np.arange(width) * slots
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = truth - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int32)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if len(own) >= 8:
                keys = flat[own].ravel()
                g = np.bincount(keys, np.repeat(grad[own], width), width * slots).reshape(width, slots).cumsum(1)
                h = np.bincount(keys, np.repeat(hess[own], width), width * slots).reshape(width, slots).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + prior) + (gt - g) ** 2 / (ht - h + prior) - gt**2 / (ht + prior)
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = 0
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6:
                    feature[k], cut[k] = j, edges[j][b]
            node[own] = 2 * k + 1 + (rows[own, feature[k]] > cut[k])
        where = node - inner
        leaf = rate * np.bincount(where, grad, inner + 1) / (np.bincount(where, hess, inner + 1) + prior)
        score += leaf[where]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(base, np.array(features), np.array(cuts, np.float32), np.array(leaves, np.float32))
