"""Gradient boosted trees for small, bounded training sets, scored as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Node = float | tuple[int, float, "Node", "Node"]  # a value, or (feature, bound, at most, above)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float) -> Node:
    value = float(g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 2:
        return value
    best, at = 1e-9, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        left_h, right_h = hs[cut], hs[-1] - hs[cut]
        gain = gs[cut] ** 2 / (left_h + 1.0) + (gs[-1] - gs[cut]) ** 2 / (right_h + 1.0) - whole
        gain[(left_h < least) | (right_h < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, at = float(gain[k]), (j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if at is None:
        return value
    low = x[:, at[0]] <= at[1]
    return at[0], at[1], _grow(x[low], g[low], h[low], depth - 1, least), _grow(x[~low], g[~low], h[~low], depth - 1, least)


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    """The tree's value of each row."""
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    low, out = x[:, node[0]] <= node[1], np.empty(len(x))
    out[low], out[~low] = _values(node[2], x[low]), _values(node[3], x[~low])
    return out


@dataclass
class Boosted:
    """Log odds: bias and rate times the sum of trees; calibrated by slope and offset fitted on held-out rows."""

    bias: float = 0.0
    rate: float = 0.3
    trees: list[Node] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -500, 500)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as an expression."""

        def build(node: Node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(features[node[0]] <= node[1], build(node[2])).otherwise(build(node[3]))

        raw: Column = F.lit(float(self.bias))
        for t in self.trees:
            raw = raw + F.lit(float(self.rate)) * build(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw * float(self.slope) + float(self.offset))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> Boosted:
    """Fits on two of every three rows and calibrates on the third."""
    held = np.arange(len(y)) % 3 == 2
    xt, yt = x[~held], y[~held]
    p = min(max(float(yt.mean()), 0.01), 0.99)
    model = Boosted(bias=math.log(p / (1 - p)), rate=rate)
    score = np.full(len(yt), model.bias)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        tree = _grow(xt, yt - prob, prob * (1 - prob), depth, least)
        model.trees.append(tree)
        score = score + rate * _values(tree, xt)
    raw, yh = model.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic regression of the held-out labels on the raw score
        q = 1 / (1 + np.exp(-(a * raw + b)))
        w = q * (1 - q) + 1e-6
        ga, gb = ((yh - q) * raw).sum() - 0.01 * (a - 1), (yh - q).sum() - 0.01 * b
        haa, hab, hbb = (w * raw * raw).sum() + 0.01, (w * raw).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    model.slope, model.offset = max(a, 0.1), b
    return model


def threshold(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float = 0.95, rows: np.ndarray | None = None) -> float:
    """The least held-out probability from which on precision holds among the given rows; 1 if none does."""
    held = (np.arange(len(y)) % 3 == 2) & (True if rows is None else rows)
    p, yh = model.probability(x[held]), y[held]
    for t in np.unique(p):
        if yh[p >= t].mean() >= precision:
            return float(t)
    return 1.0
