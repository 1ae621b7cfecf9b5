"""Gradient-boosted trees for two classes: histogram splits, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``cut`` per inner node of every complete tree, ``leaf`` values, and the first margin."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 90, depth: int = 5, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    offsets = codes + np.arange(width) * BINS
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin = np.full(n, bias)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        members = {0: np.arange(n)}
        for node in range(inner):
            rows = members.pop(node)
            best = (1e-6, None)
            if len(rows) > 1:
                flat = offsets[rows].ravel()
                g = np.bincount(flat, np.repeat(slope[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(flat, np.repeat(curve[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                total_g, total_h = slope[rows].sum(), curve[rows].sum()
                gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g ** 2 / (total_h + ridge)
                gain[(h < 1e-3) | (total_h - h < 1e-3)] = 0
                f, b = np.unravel_index(int(gain[:, :-1].argmax()), (width, BINS - 1))
                if gain[f, b] > best[0] and b < len(cuts[f]):
                    best = (gain[f, b], (int(f), int(b)))
            if best[1] is None:
                members[2 * node + 1], members[2 * node + 2] = rows, rows[:0]
                continue
            f, b = best[1]
            feature[node], cut[node] = f, cuts[f][b]
            right = codes[rows, f] > b
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        for at in range(leaves):
            rows = members[inner + at]
            leaf[at] = rate * slope[rows].sum() / (curve[rows].sum() + ridge)
            margin[rows] += leaf[at]
        trees.append((feature, cut, leaf))
    return Trees(*(np.stack(part) for part in zip(*trees)), bias)
