"""Gradient-boosted trees with monotonic constraints, as flat numpy node arrays.

Trees are complete binary trees of one depth: the children of node ``k`` are ``2k + 1`` and
``2k + 2``. A node that is not split has an infinite threshold, so that every row goes left and
ends in a leaf with the node's value. Scoring is one comparison per level for all rows and trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    feature: np.ndarray  # int32 [trees, inner nodes]
    threshold: np.ndarray  # float64 [trees, inner nodes]
    value: np.ndarray  # float64 [trees, leaves]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of ``x``."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))[:, None]
        each = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        while trees and len(x) and node[0, 0] < inner:
            split = self.feature[each, node]
            node = 2 * node + 1 + (x[rows, split] > self.threshold[each, node])
        if trees and len(x):
            total += self.value[each, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def constant(probability: float) -> FlatTrees:
    p = min(max(probability, 1e-6), 1 - 1e-6)
    none = np.zeros((0, 1))
    return FlatTrees(none.astype(np.int32), none, np.zeros((0, 2)), float(np.log(p / (1 - p))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    min_hessian: float = 1.0,
) -> FlatTrees:
    """Boosted logistic trees; ``monotone`` has -1, 0 or 1 per column for falling, free, rising.

    Without rows the model says 0.5; with one label only, nearly that label.
    """
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, columns = x.shape
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, f], quantiles, method="lower")) for f in range(columns)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    mean = y.mean()
    model = constant(float(mean))
    margin = np.full(n, model.bias)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features = np.zeros((trees, inner), np.int32)
    thresholds = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        weights = {0: float(np.clip(-grad.sum() / (hess.sum() + penalty), *bounds[0]))}
        for k in range(inner):
            here = np.nonzero(node == k)[0]
            low, high = bounds[k]
            best = None
            if len(here) > 1:
                best = _best_split(
                    binned[here], grad[here], hess[here], cuts, monotone, low, high, weights[k],
                    penalty, min_hessian,
                )
            left, right = 2 * k + 1, 2 * k + 2
            if best is None:
                node[here] = left
                weights[left] = weights[right] = weights[k]
                bounds[left] = bounds[right] = bounds[k]
                continue
            f, b, wl, wr = best
            features[t, k], thresholds[t, k] = f, cuts[f][b]
            node[here] = np.where(binned[here, f] > b, right, left)
            weights[left], weights[right] = wl, wr
            middle = (wl + wr) / 2
            bounds[left] = bounds[right] = bounds[k]
            if monotone[f] > 0:
                bounds[left], bounds[right] = (low, middle), (middle, high)
            elif monotone[f] < 0:
                bounds[left], bounds[right] = (middle, high), (low, middle)
        values[t] = [rate * weights[inner + j] for j in range(leaves)]
        margin += values[t][node - inner]
    return FlatTrees(features, thresholds, values, model.bias)


def _best_split(binned, grad, hess, cuts, monotone, low, high, weight, penalty, min_hessian):
    """(column, bin, left weight, right weight) of the best allowed split, or None."""

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + penalty) * w * w)

    total_g, total_h = grad.sum(), hess.sum()
    parent = gain(total_g, total_h, weight)
    best, found = 1e-6, None
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        size = len(cut) + 1
        gl = np.cumsum(np.bincount(binned[:, f], grad, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], hess, size))[:-1]
        gr, hr = total_g - gl, total_h - hl
        wl = np.clip(-gl / (hl + penalty), low, high)
        wr = np.clip(-gr / (hr + penalty), low, high)
        won = gain(gl, hl, wl) + gain(gr, hr, wr) - parent
        allowed = (hl >= min_hessian) & (hr >= min_hessian)
        if monotone[f]:
            allowed &= (wr - wl) * monotone[f] >= 0
        won = np.where(allowed, won, -np.inf)
        b = int(won.argmax())
        if won[b] > best:
            best, found = won[b], (f, b, float(wl[b]), float(wr[b]))
    return found
