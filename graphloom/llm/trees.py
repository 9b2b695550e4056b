"""Gradient-boosted trees and isotonic calibration in numpy, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class BoostedTrees:
    """Second-order boosting of the logistic loss over histogram bins; every tree is complete to ``depth``.

    ``prior`` is the rate that is assumed where there are no labels to learn from.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0, prior: float = 0.5):
        self.prior = prior
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.base, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        if not n or not 0 < y.mean() < 1:
            # Labels of one kind or none: their rate, with one pseudo-label of the prior.
            p = (y.sum() + self.prior) / (n + 1)
            self.base = float(np.log(p / (1 - p)))
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        # A value that most rows share leaves few quantiles; the greatest values then get cuts of their own.
        cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0.05, 0.95, 8))])) if len(v := x[x[:, j] > c.max(), j]) else c for j, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        most = max(len(c) for c in cuts) + 1
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        margin, inner = np.full(n, self.base), 2**self.depth - 1
        feature, cut, leaf = [], [], []
        for _ in range(self.rounds):
            p = _sigmoid(margin)
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, int)
            fs, cs = np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(node == first + k)
                    best = (1e-6, 0, np.inf)
                    if len(rows) > 1:
                        g, h = grad[rows], hess[rows]
                        score = lambda a, b: a * a / (b + self.ridge)
                        whole = score(g.sum(), h.sum())
                        for j in range(width):
                            b = binned[rows, j]
                            gl, hl = np.cumsum(np.bincount(b, g, most))[:-1], np.cumsum(np.bincount(b, h, most))[:-1]
                            gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - whole
                            gain[(hl < self.least) | (h.sum() - hl < self.least)] = 0
                            i = int(gain[: len(cuts[j])].argmax()) if len(cuts[j]) else 0
                            if len(cuts[j]) and gain[i] > best[0]:
                                best = (gain[i], j, cuts[j][i])
                    fs[first + k], cs[first + k] = best[1], best[2]
                node = 2 * node + 1 + (x[np.arange(n), fs[node]] > cs[node])
            ends = node - inner
            leaves = -self.rate * np.bincount(ends, grad, 2**self.depth) / (np.bincount(ends, hess, 2**self.depth) + self.ridge)
            margin += leaves[ends]
            feature.append(fs), cut.append(cs), leaf.append(leaves)
        self.feature, self.cut, self.leaf = np.array(feature), np.array(cut), np.array(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for fs, cs, leaves in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, fs[node]] > cs[node])
            out += leaves[node - len(fs)]
        return out


class Isotonic:
    """Least-squares non-decreasing map from margins to probabilities, by pooling adjacent violators.

    Between the pools' centres it is linear. Pools are pulled a little to the plain logistic curve (``weight``
    pseudo-observations), so that a pool of few rows doesn't claim certainty.
    """

    def __init__(self, weight: float = 1.0):
        self.weight, self.at, self.value = weight, np.zeros(0), np.zeros(0)

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if len(y) < 20 or not 0 < y.mean() < 1:
            return self
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v in zip(margin[order], y[order], strict=True):
            pools.append([m, v, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                m2, v2, n2 = pools.pop()
                pools[-1] = [pools[-1][0] + m2, pools[-1][1] + v2, pools[-1][2] + n2]
        sums = np.array(pools)
        self.at = sums[:, 0] / sums[:, 2]
        value = (sums[:, 1] + self.weight * _sigmoid(self.at)) / (sums[:, 2] + self.weight)
        self.value = np.maximum.accumulate(value)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value) if len(self.at) else _sigmoid(margin)
