"""Gradient-boosted trees over binned dense features, and isotonic calibration; numpy, for a bounded sample of rows."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting: each tree splits the best leaf by gain on quantile bins of the features."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.cuts: list[np.ndarray] = []
        self.grown: list[list[tuple]] = []
        self.prior = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.prior = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            tree = self._grow(b, g, h)
            self.grown.append(tree)
            raw += self._values(tree, b)
        return self

    def _grow(self, b, g, h) -> list[tuple]:
        """Nodes (feature, bin, left, right, value); a leaf has feature -1."""
        nodes: list[tuple] = []
        size = self.bins + 1

        def build(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            sg, sh = g[rows].sum(), h[rows].sum()
            nodes.append((-1, 0, 0, 0, float(-self.rate * sg / (sh + self.l2))))
            if depth == self.depth or len(rows) < 2 * self.least:
                return me
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                col = b[rows, j]
                n = np.cumsum(np.bincount(col, minlength=size))[:-1]
                gl = np.cumsum(np.bincount(col, weights=g[rows], minlength=size))[:-1]
                hl = np.cumsum(np.bincount(col, weights=h[rows], minlength=size))[:-1]
                gain = gl**2 / (hl + self.l2) + (sg - gl) ** 2 / (sh - hl + self.l2) - sg**2 / (sh + self.l2)
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                left = b[rows, best[1]] <= best[2]
                lo, hi = build(rows[left], depth + 1), build(rows[~left], depth + 1)
                nodes[me] = (best[1], best[2], lo, hi, 0.0)
            return me

        build(np.arange(len(g)), 0)
        return nodes

    @staticmethod
    def _values(tree: list[tuple], b: np.ndarray) -> np.ndarray:
        feature, cut, lo, hi = (np.array([n[k] for n in tree]) for k in range(4))
        value = np.array([n[4] for n in tree])
        at = np.zeros(len(b), int)
        while len(b):
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            f = at[inner]
            at[inner] = np.where(b[inner, feature[f]] <= cut[f], lo[f], hi[f])
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x) if len(x) else np.zeros((0, len(self.cuts)), np.int16)
        return self.prior + sum((self._values(t, b) for t in self.grown), np.zeros(len(b)))


class Isotonic:
    """The non-decreasing step function closest to weighted labels (pool adjacent violators), linear between blocks."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray):
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, lowest and highest raw
        for r, v, w in zip(raw[order], y[order].astype(float), weight[order], strict=True):
            blocks.append([v, w, r, r])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                v2, w2, _, hi = blocks.pop()
                v1, w1, lo, _ = blocks.pop()
                blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        self.y = np.array([b[0] for b in blocks for _ in range(2)])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """In [0, 1]; the raw order breaks ties within a block by less than any block's own step could matter."""
        if not len(self.x):
            return np.full(len(raw), 0.0)
        base = np.interp(raw, self.x, self.y)
        return np.clip(base * 0.999 + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)
