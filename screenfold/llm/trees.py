"""Gradient-boosted trees in numpy, flattened into node arrays.

Trained on a bounded sample in one process, applied to any number of rows by array lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays. A leaf has itself as both children, so every row takes
    ``depth`` steps and no branch."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            go = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic boosting on histograms.

    ``monotone`` has -1, 0 or 1 per feature: splits that would break the direction are refused, and
    the middle of two children bounds everything below them, so the whole model keeps the direction.
    Ties between splits go to the first feature and the lowest threshold.
    """
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, k), int)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    arrays: dict[str, list] = {a: [] for a in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def node() -> int:
        at = len(arrays["value"])
        for a, v in zip(arrays, (0, np.inf, at, at, 0.0)):
            arrays[a].append(v)
        return at

    def grow(at: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        sg, sh = g.sum(), h.sum()
        arrays["value"][at] = rate * float(np.clip(-sg / (sh + ridge), low, high))
        if level == depth or len(rows) < 2:
            return
        best = (1e-9, None)
        for j in range(k):
            if not len(edges[j]):
                continue
            c = code[rows, j]
            lg = np.cumsum(np.bincount(c, g, len(edges[j]) + 1))[:-1]
            lh = np.cumsum(np.bincount(c, h, len(edges[j]) + 1))[:-1]
            wl, wr = np.clip(-lg / (lh + ridge), low, high), np.clip(-(sg - lg) / (sh - lh + ridge), low, high)
            gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
            gain[(lh < least) | (sh - lh < least) | (monotone[j] * (wr - wl) < 0)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (j, i, wl[i], wr[i]))
        if best[1] is None:
            return
        j, i, wl, wr = best[1]
        go = code[rows, j] <= i
        lo, hi = node(), node()
        arrays["feature"][at], arrays["threshold"][at], arrays["left"][at], arrays["right"][at] = j, edges[j][i], lo, hi
        mid = (wl + wr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
        grow(lo, rows[go], level + 1, *bounds[0])
        grow(hi, rows[~go], level + 1, *bounds[1])

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(root := node())
        grow(root, np.arange(n), 0, -np.inf, np.inf)
        one = Forest(*(np.array(arrays[a]) for a in arrays), np.array([root]), depth, 0.0)
        score += one.margin(x)
    return Forest(*(np.array(arrays[a]) for a in arrays), np.array(roots, dtype=int), depth, base)
