"""Gradient-boosted trees for a yes/no answer, and isotonic calibration, in NumPy.

Trees are oblivious of order: features are cut into at most 32 bins once, each
tree grows level by level from histograms of gradients, and a model is a few
small arrays that any executor can apply to a matrix without loops over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    least_weight: float = 2.0
    penalty: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    leaf: np.ndarray | None = None
    start: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, margin: np.ndarray | None = None) -> BoostedTrees:
        """``margin``: log odds known beforehand, which the trees correct; without rows or gain they stay as they are."""
        w = np.ones(len(y)) if weight is None else weight
        marks = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            self.edges.append((values[:-1] + values[1:]) / 2 if len(values) <= self.bins else np.unique(np.quantile(values, marks)))
        b = self._binned(x)
        mean = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean))) if margin is None else 0.0
        score = np.full(len(y), self.start) if margin is None else margin.astype(float)
        nodes, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, nodes), np.int32)
        self.cut = np.full((self.trees, nodes), self.bins + 1, np.int32)
        self.leaf = np.zeros((self.trees, leaves))
        width, size = x.shape[1], self.bins + 1
        column = np.arange(width)[None, :] * size
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                # histograms of all features in one pass: cell = (node, feature, bin)
                slot = (node[:, None] * (width * size) + column + b).ravel()
                hist = lambda v: np.bincount(slot, np.repeat(v, width), count * width * size).reshape(count, width, size).cumsum(axis=2)
                hg, hh = hist(g), hist(h)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + self.penalty) + (tg - hg) ** 2 / (th - hh + self.penalty) - tg**2 / (th + self.penalty)
                gain[(hh < self.least_weight) | (th - hh < self.least_weight)] = 0
                flat = gain.reshape(count, -1)
                at = flat.argmax(axis=1) if flat.shape[1] else np.zeros(count, np.int64)
                better = flat[np.arange(count), at] > 1e-9 if flat.shape[1] else np.zeros(count, bool)
                choice = np.stack([np.where(better, at // size, 0), np.where(better, at % size, self.bins + 1)], axis=1)
                self.feature[t, first : first + count], self.cut[t, first : first + count] = choice[:, 0], choice[:, 1]
                node = 2 * node + (b[np.arange(len(y)), choice[node, 0]] > choice[node, 1])
            sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.leaf[t] = self.rate * sg / (sh + self.penalty)
            score += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray, margin: np.ndarray | None = None) -> np.ndarray:
        """Log odds of each row."""
        b = self._binned(x)
        rows, out = np.arange(len(x)), np.full(len(x), self.start) if margin is None else margin.astype(float)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][node]
        return out


@dataclass
class Isotonic:
    """Probabilities that never fall as the score rises (pool adjacent violators)."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        order = np.argsort(score, kind="stable")
        w = np.ones(len(y)) if weight is None else weight
        blocks: list[list[float]] = []  # mean, weight, least score, greatest score
        for s, v, k in zip(score[order], y[order], w[order]):
            blocks.append([float(v), float(k), float(s), float(s)])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                b, a = blocks.pop(), blocks.pop()
                total = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([v for b in blocks for v in (b[0], b[0])])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
