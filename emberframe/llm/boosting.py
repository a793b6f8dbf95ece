"""Gradient-boosted trees for two classes, over binned features; small enough to train on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth.  Node i of a level has children 2i and 2i + 1 on the next."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): greater values go right
    leaf: np.ndarray  # (trees, leaves)

    def logits(self, x: np.ndarray) -> np.ndarray:
        depth = (self.leaf.shape[1]).bit_length() - 1
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(depth):
                inner = (1 << level) - 1 + at
                at = 2 * at + (x[rows, feature[inner]] > cut[inner])
            out += leaf[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; every level picks the best cut of each of its nodes."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    # Bin b holds values in (edge b-1, edge b]; a cut after bin b is "greater than edge b".
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), (1 << depth) - 1
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            total_g = np.bincount(at, grad, nodes)
            total_h = np.bincount(at, hess, nodes)
            best = np.full(nodes, 1e-6)
            here = slice(nodes - 1, 2 * nodes - 1)
            for f in range(width):
                k = len(edges[f]) + 1
                if k < 2:
                    continue
                slot = at * k + binned[:, f]
                g = np.bincount(slot, grad, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                h = np.bincount(slot, hess, nodes * k).reshape(nodes, k).cumsum(axis=1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + l2) + rest_g**2 / (rest_h + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(h < 1e-3) | (rest_h < 1e-3)] = 0
                top = gain.argmax(axis=1)
                won = gain[np.arange(nodes), top] > best
                best = np.where(won, gain[np.arange(nodes), top], best)
                feature[t, here] = np.where(won, f, feature[t, here])
                cut[t, here] = np.where(won, edges[f][top], cut[t, here])
            chosen = nodes - 1 + at
            at = 2 * at + (x[np.arange(n), feature[t, chosen]] > cut[t, chosen])
        leaf[t] = -rate * np.bincount(at, grad, 1 << depth) / (np.bincount(at, hess, 1 << depth) + l2)
        score += leaf[t][at]
    return Boosted(base, feature, cut, leaf)
