"""Gradient-boosted trees in numpy: trained on a bounded sample, flattened into node arrays, scored in vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees: a node's children lie at left and left + 1; a leaf has feature -1. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(go, self.left[at] + right, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic loss. monotone[f] is -1 or 1 where the score may only fall or rise with feature f, else 0: a split that breaks this is
    not taken, and the halves below it keep to their side of its middle. No rows, or one class alone: a constant."""
    n, width = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(positive / (1 - positive)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
            while todo:
                node, rows, level, low, high = todo.pop()
                weight = lambda a, b: np.clip(a / (b + ridge), low, high)  # noqa: B023, E731
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = rate * float(weight(gs, hs))
                best = (1e-6, -1, 0, 0.0, 0.0)
                if level < depth:
                    for f in range(width):
                        m = len(edges[f]) + 1
                        gl, hl = (np.cumsum(np.bincount(code[rows, f], v[rows], m))[:-1] for v in (g, h))
                        gr, hr = gs - gl, hs - hl
                        wl, wr = weight(gl, hl), weight(gr, hr)
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least) | (hr < least)] = -1
                        if monotone[f]:
                            gain[monotone[f] * (wr - wl) < 0] = -1
                        if len(gain) and gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (gain[k], f, k, wl[k], wr[k])
                if best[1] < 0:
                    margin[rows] += value[node]
                    continue
                _, f, k, wl, wr = best
                feature[node], threshold[node], left[node] = f, float(edges[f][k]), len(feature)
                right = code[rows, f] > k
                mid = (wl + wr) / 2
                for side, own in ((0, rows[~right]), (1, rows[right])):
                    feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                    lo, hi = low, high
                    if monotone[f]:
                        lo, hi = (low, min(high, mid)) if (side == 0) == (monotone[f] > 0) else (max(low, mid), high)
                    todo.append((left[node] + side, own, level + 1, lo, hi))
    return Forest(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(value, float), np.array(roots, np.int64), base, depth)
