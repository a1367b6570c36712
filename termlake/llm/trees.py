"""Gradient-boosted trees for yes-or-no questions, on binned features."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Trees:
    """Complete trees of one depth: for each inner node a feature and a bound,
    for each leaf a value. Values up to the bound go left."""
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray
    leaf: np.ndarray  # trees x leaves
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32,
        least_rows: float = 4.0, smooth: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    margin, made = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, bound, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            node = at - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key, size = node * (len(e) + 1) + binned[f], width * (len(e) + 1)
                g, h, n = (np.bincount(key, w, size).reshape(width, -1).cumsum(axis=1)
                           for w in (slope, bend, np.ones(len(y))))
                total = lambda v: v[:, -1:] - v[:, :-1]  # noqa: E731  what goes right
                gain = (g[:, :-1] ** 2 / (h[:, :-1] + smooth) + total(g) ** 2 / (total(h) + smooth)
                        - g[:, -1:] ** 2 / (h[:, -1:] + smooth))
                gain[(n[:, :-1] < least_rows) | (total(n) < least_rows)] = 0
                k = gain.argmax(axis=1)
                value = gain[np.arange(width), k]
                won = value > best + 1e-9
                best[won], feature[first + np.flatnonzero(won)] = value[won], f
                bound[first + np.flatnonzero(won)] = e[k[won]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > bound[at])
        at -= inner
        g, h = np.bincount(at, slope, inner + 1), np.bincount(at, bend, inner + 1)
        leaf = rate * g / (h + smooth)
        margin += leaf[at]
        made.append((feature, bound, leaf))
    feature, bound, leaf = (np.stack(c) for c in zip(*made, strict=True))
    return Trees(feature, bound, leaf, prior)
