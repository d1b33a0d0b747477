"""Histogram gradient-boosted trees for two classes, as flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node ``i`` has the children ``2i+1`` and ``2i+2``.

    ``feature`` and ``threshold``: (trees, 2**depth - 1); ``leaf``: (trees, 2**depth). A row goes right where
    its value exceeds the threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            depth = int(np.log2(self.leaf.shape[1]))
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1,
        least_rows: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for logistic loss. Values are binned once at quantiles; each level of a tree is grown from
    one histogram of gradients over (node, feature, bin). Rows of one class only, or none, give their prior.
    """
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    nodes, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cell = binned + bins * np.arange(width)
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, leaves))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (bins * width) + cell).ravel()
            g, h, c = (np.bincount(at, np.repeat(v, width), many * bins * width).reshape(many, width, bins).cumsum(axis=2)
                       for v in (grad, hess, np.ones(n)))
            sums = [(v, v[:, :, -1:] - v) for v in (g, h, c)]
            (gl, gr), (hl, hr), (cl, cr) = sums
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
            gain[(cl < least_rows) | (cr < least_rows)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - nodes
        leaf[t] = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        total += leaf[t, at]
    return Trees(feature, threshold, leaf, base)
