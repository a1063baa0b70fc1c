"""Gradient-boosted trees for two classes, on a small table of binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting with depth-limited trees on up to 32 bins a feature; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.smooth, self.bins = rounds, depth, rate, smooth, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b = self._bin(x)
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * self._run(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: split features and bins by node, values by leaf."""
        nodes = 2**self.depth - 1
        feature, at = np.zeros(nodes, int), np.full(nodes, self.bins, int)
        where = np.zeros(len(g), int)
        for level in range(self.depth):
            base, wide = 2**level - 1, 2**level
            own = where - base
            best = np.full(wide, 1e-9)
            for j in range(b.shape[1]):
                key = own * (self.bins + 1) + b[:, j]
                gs = np.bincount(key, g, wide * (self.bins + 1)).reshape(wide, -1)
                hs = np.bincount(key, h, wide * (self.bins + 1)).reshape(wide, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better] = value[better]
                feature[base : base + wide][better] = j
                at[base : base + wide][better] = top[better]
            where = 2 * where + 1 + (b[np.arange(len(g)), feature[where]] > at[where])
        leaf = where - nodes
        value = np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + self.smooth)
        return feature, at, value

    def _run(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, at, value = tree
        where = np.zeros(len(b), int)
        for _ in range(self.depth):
            where = 2 * where + 1 + (b[np.arange(len(b)), feature[where]] > at[where])
        return value[where - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + self.rate * sum((self._run(t, b) for t in self.trees), np.zeros(len(x)))
