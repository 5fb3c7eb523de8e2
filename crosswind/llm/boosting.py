"""Gradient-boosted trees for a yes or no, fitted in numpy on the driver and applied as a DataFrame expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: int = -1
    below: float = 0.0
    value: float = 0.0
    yes: "Tree | None" = None
    no: "Tree | None" = None


@dataclass
class Boosted:
    """start plus the trees' values is a log odds; scale and shift calibrate it; probability >= threshold says yes."""

    names: list[str]
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _apply(t, x)
        return self.scale * out + self.shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def says(self, features: Column) -> Column:
        """The verdict on a struct with a field for each name."""

        def value(t: Tree) -> Column:
            if t.feature < 0:
                return F.lit(float(t.value))
            return F.when(features[self.names[t.feature]] < float(t.below), value(t.yes)).otherwise(value(t.no))

        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + value(t)
        cut = np.log(self.threshold / (1 - self.threshold))
        return total * float(self.scale) + float(self.shift) >= float(cut)


def _apply(t: Tree, x: np.ndarray) -> np.ndarray:
    if t.feature < 0:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] < t.below, _apply(t.yes, x), _apply(t.no, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int = 8) -> Tree:
    """A tree on gradients g and curvatures h, by exact search over the values of each feature."""
    leaf = Tree(value=rate * float(g.sum() / (h.sum() + 1)))
    if not depth or len(x) < 2 * least:
        return leaf
    best, whole = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (at + 1 <= len(x) - least)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - whole
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), k, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] < 0:
        return leaf
    yes = x[:, best[1]] < best[2]
    return Tree(best[1], best[2], 0.0, _grow(x[yes], g[yes], h[yes], depth - 1, rate, least), _grow(x[~yes], g[~yes], h[~yes], depth - 1, rate, least))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Boosted:
    """Fits on two thirds of the rows; the rest calibrate the log odds and set the lowest threshold of that precision."""
    model = Boosted(names)
    if not len(y) or y.min() == y.max():
        model.start = -20.0 if not len(y) or not y.max() else 20.0
        return model
    fold = np.arange(len(y)) % 3 == 0
    a, b = x[~fold], y[~fold].astype(float)
    model.start = float(np.log((b.mean() + 1e-3) / (1 - b.mean() + 1e-3)))
    m = np.full(len(a), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        t = _grow(a, b - p, p * (1 - p), depth, rate)
        model.trees.append(t)
        m += _apply(t, a)
    raw, truth = model.margin(x[fold]), y[fold].astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Platt scaling, by Newton's method with a small ridge towards no change
        p = 1 / (1 + np.exp(-np.clip(w[0] * raw + w[1], -30, 30)))
        z = np.stack([raw, np.ones_like(raw)])
        grad = z @ (truth - p) - (w - np.array([1.0, 0.0]))
        w = w + np.linalg.solve((z * (p * (1 - p))) @ z.T + np.eye(2), grad)
    model.scale, model.shift = map(float, w)
    p = model.probability(x[fold])
    for cut in np.arange(0.05, 1.0, 0.05):
        if (said := p >= cut).any() and truth[said].mean() >= precision:
            model.threshold = float(cut)
            break
    else:
        model.threshold = 0.95
    return model
