"""Small gradient-boosted trees for binary labels, in numpy, and their form as a SQL column."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> Tree:
    leaf = float(grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return leaf
    parent, best = grad.sum() ** 2 / (hess.sum() + 1.0), (1e-6, None)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(h[cut] >= least) & (h[-1] - h[cut] >= least)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1.0) - parent
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    if best[1] is None:
        return leaf
    j, at = best[1]
    left = x[:, j] <= at
    return (j, at, _grow(x[left], grad[left], hess[left], depth - 1, least), _grow(x[~left], grad[~left], hess[~left], depth - 1, least))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, at, low, high = tree
    left = x[:, j] <= at
    out = np.empty(len(x))
    out[left], out[~left] = _value(low, x[left]), _value(high, x[~left])
    return out


class Boosted:
    """Logistic boosting; held-out rows calibrate the scores and pick a threshold for each kind of row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, held: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, precision: float = 0.98):
        fit_x, fit_y = x[~held], y[~held].astype(float)
        share = np.clip(fit_y.mean(), 0.01, 0.99)
        self.start, self.rate, self.trees = float(np.log(share / (1 - share))), rate, []
        raw = np.full(len(fit_x), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree = _grow(fit_x, fit_y - p, p * (1 - p), depth, 1.0)
            self.trees.append(tree)
            raw += rate * _value(tree, fit_x)
        self.slope, self.shift = _platt(self.raw(x[held]), y[held].astype(float))
        p = self.probability(x)
        self.thresholds = {int(k): _threshold(p[held & (kind == k)], y[held & (kind == k)], precision) for k in np.unique(kind)}

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(_value(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The calibrated probability over feature columns."""

        def of(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, at, low, high = tree
            return F.when(feature(j) <= at, of(low)).otherwise(of(high))

        raw = functools.reduce(operator.add, [of(t) * self.rate for t in self.trees], F.lit(self.start))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * self.slope + self.shift)))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic calibration, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([((y - p) * raw).sum() - (a - 1), (y - p).sum() - b])
        w = p * (1 - p)
        h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which held-out precision is reached; half-way into the gap below the least score that it takes."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.ones(len(p), bool)
    last[:-1] = p[order][1:] < p[order][:-1]
    good = np.flatnonzero(last & (hits >= precision))
    if not len(good):
        return 0.99
    at = good[-1]
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(min(0.99, max(0.05, (p[order][at] + below) / 2)))
