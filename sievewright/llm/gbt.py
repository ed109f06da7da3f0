"""Gradient-boosted trees over numpy arrays: logistic loss, histogram splits, level by level."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of a fixed depth as flat arrays; node i has children 2i+1 and 2i+2."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 1.0):
        self.n, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, cuts, weight * (q - y), weight * q * (1 - q))
            raw += tree[2][leaf]
            self.trees.append(tree)
        return self

    def _grow(self, binned, cuts, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        at = np.zeros(len(g), np.int64)
        d = binned.shape[1]
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            gain = np.full((count, d, BINS), -np.inf)
            local = at - first
            for f in range(d):
                key = local * BINS + binned[:, f]
                gs = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)
                hs = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                ok = (hs >= self.least) & (ht - hs >= self.least)
                gain[:, f] = np.where(ok, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), -np.inf)
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            good = flat[np.arange(count), best] > 1e-6
            for k in np.flatnonzero(good):
                f, b = divmod(int(best[k]), BINS)
                if b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            edge = np.array([np.searchsorted(cuts[feature[i]], cut[i], side="left") if np.isfinite(cut[i]) else BINS for i in range(first, first + count)])
            right = binned[np.arange(len(g)), feature[at]] > edge[local]
            at = 2 * at + 1 + right
        gs, hs = np.bincount(at, g, size), np.bincount(at, h, size)
        value = -self.rate * gs / (hs + 1)
        return (feature, cut, value), at

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += value[at]
        return 1 / (1 + np.exp(-raw))
