"""Gradient-boosted trees in numpy for small, dense tables, with isotonic calibration; trees can become SQL.

Training runs on the driver over a bounded sample.  Scores can be taken in numpy (``predict``) or as a DataFrame
expression (``column``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes by number: inner nodes have a feature, leaves have -1.  A value below ``cut`` (or at it) goes left."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        f, c, lo, hi = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        while (inner := f[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            at[rows] = np.where(x[rows, f[n]] <= c[n], lo[n], hi[n])
        return np.asarray(self.value)[at]

    def column(self, features, n: int = 0):
        from pyspark.sql import functions as F

        if self.feature[n] < 0:
            return F.lit(float(self.value[n]))
        go = features[self.feature[n]] <= F.lit(float(self.cut[n]))
        return F.when(go, self.column(features, self.left[n])).otherwise(self.column(features, self.right[n]))


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    #: Isotonic map from margin to probability: knots and values (empty: logistic).
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, self.knots, self.levels) if len(self.knots) else 1 / (1 + np.exp(-m))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.knots, self.levels = isotonic(self.margin(x), y)

    def column(self, features):
        """The margin as a DataFrame expression over a list of columns."""
        from pyspark.sql import functions as F

        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + t.column(features)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing map from score to the rate of ones, as knots of a piecewise line."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-1][2] <= blocks[-2][3] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            a = blocks.pop()
            b = blocks[-1]
            blocks[-1] = [b[0] + a[0], b[1] + a[1], b[2], a[3]]
    knots, levels = [], []
    for total, weight, first, last in blocks:
        for at in dict.fromkeys((first, last)):
            knots.append(at)
            levels.append((total + 0.5 * 0.02) / (weight + 0.02))  # never quite 0 or 1
    return np.asarray(knots), np.asarray(levels)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, penalty: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss over binned features; no randomness, so the same rows give the same trees."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, width = x.shape
    cuts = []
    for j in range(width):
        v = np.unique(x[:, j])
        mid = (v[:-1] + v[1:]) / 2
        cuts.append(mid if len(mid) < bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins - 1))))
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1) if width else np.zeros((n, 0), int)
    rate_of = min(max(float(y.mean()) if n else 0.5, 1e-4), 1 - 1e-4)
    model = Boosted(float(np.log(rate_of / (1 - rate_of))), [])
    margin = np.full(n, model.base)

    def grow(tree: Tree, rows: np.ndarray, g: np.ndarray, h: np.ndarray, d: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        at = tree.add(float(-rate * gs / (hs + penalty)))
        if d == 0 or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, 0)
        for j in range(width):
            if not len(cuts[j]):
                continue
            b, k = binned[rows, j], len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(b, g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], k))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
            gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            c = int(np.argmax(gain))
            if gain[c] > best[0]:
                best = (float(gain[c]), j, c)
        _, j, c = best
        if j >= 0:
            go = binned[rows, j] <= c
            tree.feature[at], tree.cut[at] = j, float(cuts[j][c])
            tree.left[at] = grow(tree, rows[go], g, h, d - 1)
            tree.right[at] = grow(tree, rows[~go], g, h, d - 1)
        return at

    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = Tree()
        grow(tree, np.arange(n), p - y, p * (1 - p), depth)
        margin += tree.predict(x)
        model.trees.append(tree)
    return model
