"""Gradient-boosted regression trees for a logistic loss, in numpy; small enough to send to every task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: per tree and inner node a feature and a cut, per leaf a value."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = int(np.log2(self.leaves.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, bins: int = 32) -> Trees:
    """Newton boosting on binned features; deterministic."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    z = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    all_f, all_c, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, c, v = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            for j in range(d):
                if not len(edges[j]) or not len(rows):
                    continue
                gs, hs = (np.cumsum(np.bincount(binned[rows, j], w[rows], len(edges[j]) + 1)) for w in (g, h))
                gain = gs[:-1] ** 2 / (hs[:-1] + penalty) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + penalty) - gs[-1] ** 2 / (hs[-1] + penalty)
                if gain.max() > best:
                    best, f[k], c[k] = gain.max(), j, edges[j][int(gain.argmax())]
            node[rows] = 2 * k + 1 + (x[rows, f[k]] > c[k])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        z += v[leaf]
        all_f.append(f)
        all_c.append(c)
        all_v.append(v)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_v), start)
