"""Gradient-boosted trees on binned features, and isotonic calibration.

Training works on small tables: a bounded sample, or counts per combination of
bins. The fitted model is applied by Spark, as arrays or as a SQL expression.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A full binary tree: node i has children 2 i + 1 and 2 i + 2."""

    feature: list  # -1 at leaves
    cut: list  # left if the bin is at most this
    value: list

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        rows = np.arange(len(bins))
        for _ in range(len(self.feature).bit_length()):
            f = feature[node]
            right = bins[rows, np.maximum(f, 0)] > cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return np.array(self.value)[node]

    def expression(self, columns: list[Column], node: int = 0) -> Column:
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        return F.when(
            columns[self.feature[node]] <= self.cut[node],
            self.expression(columns, 2 * node + 1),
        ).otherwise(self.expression(columns, 2 * node + 2))


@dataclass
class Model:
    base: float
    trees: list

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.leaves(bins)
        return out

    def expression(self, columns: list[Column]) -> Column:
        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + tree.expression(columns)
        return out


def _grow(bins, gradient, hessian, n_bins, depth, ridge) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree = Tree([-1] * size, [0] * size, [0.0] * size)
    rows = {0: np.arange(len(bins))}
    for node in range(size):
        own = rows.pop(node, None)
        if own is None:
            continue
        g, h = gradient[own], hessian[own]
        total_g, total_h = g.sum(), h.sum()
        tree.value[node] = -total_g / (total_h + ridge)
        if 2 * node + 2 >= size:
            continue
        best = (1e-6, None)
        for f in range(bins.shape[1]):
            left_g = np.cumsum(np.bincount(bins[own, f], g, n_bins))[:-1]
            left_h = np.cumsum(np.bincount(bins[own, f], h, n_bins))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = (left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
                    - total_g**2 / (total_h + ridge))
            gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (gain[cut], (f, cut))
        if best[1] is not None:
            f, cut = best[1]
            tree.feature[node], tree.cut[node] = f, cut
            right = bins[own, f] > cut
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return tree


def fit(bins: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, trees: int = 60,
        depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Model:
    """Logistic loss; both labels have to occur."""
    weight = np.ones(len(label)) if weight is None else weight.astype(float)
    mean = np.clip((weight * label).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = Model(float(np.log(mean / (1 - mean))), [])
    margin = np.full(len(label), model.base)
    n_bins = int(bins.max(initial=0)) + 2
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(bins, weight * (p - label), weight * p * (1 - p), n_bins, depth, ridge)
        tree.value = [rate * v for v in tree.value]
        margin += tree.leaves(bins)
        model.trees.append(tree)
    return model


def quantile_cuts(values: np.ndarray, n_bins: int = 32) -> list[np.ndarray]:
    """Cuts of each feature at its quantiles."""
    at = np.linspace(0, 1, n_bins + 1)[1:-1]
    return [np.unique(np.quantile(values[:, f], at)) for f in range(values.shape[1])]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, f], "left") for f, c in enumerate(cuts)],
                    axis=1).astype(np.int64)


def isotonic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None):
    """Margins and non-decreasing rates between which to interpolate."""
    order = np.argsort(margin, kind="stable")
    weight = np.ones(len(label)) if weight is None else weight
    blocks: list[list] = []  # weight, weight x rate, weight x margin
    for m, y, w in zip(margin[order], label[order], weight[order]):
        blocks.append([w, w * y, w * m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    w, y, m = np.array(blocks).T
    # Rule of succession: no rate is 0 or 1 on finite evidence.
    return m / w, np.maximum.accumulate((y + 0.5) / (w + 1)) if len(w) > 1 else y / w
