"""Gradient-boosted trees for two classes, small enough to be trained on the driver and sent to the workers."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Trees of the gradient of the logistic loss over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base = 0.0
        self.nodes: list[tuple] = []
        self._asked = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = math.log(p / (1 - p))
        if not len(y):
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth, score)
            self.nodes.append(tree)
        return self

    def _grow(self, binned, edges, gradient, hessian, rows, depth, score):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gs = np.cumsum(np.bincount(b, gradient[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(b, hessian[rows], len(e) + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            value = float(self.rate * g / (h + 1))
            score[rows] += value
            return value
        _, j, k = best
        left = binned[rows, j] <= k
        return (
            j,
            float(edges[j][k]),
            self._grow(binned, edges, gradient, hessian, rows[left], depth - 1, score),
            self._grow(binned, edges, gradient, hessian, rows[~left], depth - 1, score),
        )

    def score(self, row) -> float:
        """The log odds of one row. The trees are one compiled expression, made where they are first asked."""
        if self._asked is None:
            terms = " + ".join([repr(self.base), *map(_expression, self.nodes)])
            self._asked = eval(f"lambda r: {terms}", {"__builtins__": {}})  # noqa: S307 - numbers of this model alone
        return self._asked(row)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_asked": None}


def _expression(node) -> str:
    """A tree as an expression of the row r."""
    if type(node) is not tuple:
        return repr(node)
    j, edge, low, high = node
    return f"({_expression(low)} if r[{j}] <= {edge!r} else {_expression(high)})"
