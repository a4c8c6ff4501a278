"""Gradient-boosted regression trees for small binary classifiers, in numpy.

Logistic loss, depth-limited trees over binned features, second-order leaf values. Training
is for bounded, generated or sampled rows; scoring is a few vector operations a tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Booster:
    """Parameters and fitted trees; a tree is arrays of feature, threshold and leaf values."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    least: float = 2.0
    base: float = 0.0
    fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    stacked: tuple[np.ndarray, ...] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Booster":
        x = np.asarray(x, dtype=np.float64)
        y = np.asarray(y, dtype=np.float64)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.fitted, self.stacked = float(np.log(p / (1 - p))), [], None
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        nodes = 2**self.depth
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            feature, cut = np.zeros(nodes - 1, dtype=np.int64), np.full(nodes - 1, np.inf)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                local = at - first
                gs, hs = np.bincount(local, g, width), np.bincount(local, h, width)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    key = local * k + binned[:, f]
                    gl = np.bincount(key, g, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                    hl = np.bincount(key, h, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + self.least) + gr**2 / (hr + self.least) - (gs**2 / (hs + self.least))[:, None]
                    j = gain.argmax(axis=1)
                    top = gain[np.arange(width), j]
                    for n in np.nonzero(top > best)[0]:
                        best[n], feature[first + n], cut[first + n] = top[n], f, e[j[n]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (nodes - 1)
            value = self.rate * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + self.least)
            score += value[leaf]
            self.fitted.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class."""
        x = np.asarray(x, dtype=np.float64)
        if not self.fitted:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        if self.stacked is None:
            self.stacked = tuple(np.stack(a) for a in zip(*self.fitted))
        feature, cut, value = self.stacked
        out = np.empty(len(x))
        for lo in range(0, len(x), 8192):  # all trees at once, some rows at a time
            part = x[lo : lo + 8192]
            rows, trees = np.arange(len(part))[:, None], np.arange(len(feature))[None, :]
            at = np.zeros((len(part), len(feature)), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[rows, feature[trees, at]] > cut[trees, at])
            out[lo : lo + 8192] = value[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-(out + self.base)))
