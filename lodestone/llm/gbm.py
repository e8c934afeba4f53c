"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotone constraints.

Trees are complete binary trees of one depth, held in flat arrays: node n has children
2n+1 and 2n+2, a row goes left where its feature value is at most the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature and threshold: (trees, inner nodes); value: (trees, leaves); base: starting log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1])) if self.value.size else 0

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 32,
    ridge: float = 2.0,
    least: float = 1.0,
    monotone: dict[int, int] | None = None,
) -> Trees:
    """Boost trees on 0/1 labels. monotone: feature index to +1 (never falls) or -1 (never rises)."""
    rows, labels, monotone = np.asarray(rows, float), np.asarray(labels, float), monotone or {}
    rate_of_ones = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    width = rows.shape[1]
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(width)], axis=1)
    margin = np.full(len(rows), base)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = labels - p, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            for n in range(first, 2 * first + 1):
                inside = np.flatnonzero(node == n)
                low[2 * n + 1] = low[2 * n + 2] = low[n]
                high[2 * n + 1] = high[2 * n + 2] = high[n]
                if len(inside) < 2:
                    continue
                split = _best_split(codes[inside], slope[inside], curve[inside], edges, ridge, least, monotone, low[n], high[n])
                if split is None:
                    continue
                j, code, left, right = split
                feature[n], threshold[n] = j, edges[j][code]
                middle, sign = (left + right) / 2, monotone.get(j, 0)
                if sign > 0:
                    high[2 * n + 1], low[2 * n + 2] = middle, middle
                elif sign < 0:
                    low[2 * n + 1], high[2 * n + 2] = middle, middle
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        leaf = node - inner
        up, down = np.bincount(leaf, slope, leaves), np.bincount(leaf, curve, leaves)
        value = rate * np.clip(up / (down + ridge), low[inner:], high[inner:])
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(*(np.stack(part) for part in zip(*grown, strict=True)), base)


def _best_split(codes, slope, curve, edges, ridge, least, monotone, low, high):
    best, found = 1e-9, None
    total_up, total_down = slope.sum(), curve.sum()
    for j, cuts in enumerate(edges):
        if not len(cuts):
            continue
        up = np.cumsum(np.bincount(codes[:, j], slope, len(cuts) + 1))[:-1]
        down = np.cumsum(np.bincount(codes[:, j], curve, len(cuts) + 1))[:-1]
        left = np.clip(up / (down + ridge), low, high)
        right = np.clip((total_up - up) / (total_down - down + ridge), low, high)
        gain = _gain(up, down, left, ridge) + _gain(total_up - up, total_down - down, right, ridge)
        whole = np.clip(total_up / (total_down + ridge), low, high)
        gain = gain - _gain(total_up, total_down, whole, ridge)
        allowed = (down >= least) & (total_down - down >= least)
        sign = monotone.get(j, 0)
        if sign:
            allowed &= sign * (right - left) >= 0
        gain = np.where(allowed, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, k, float(left[k]), float(right[k]))
    return found


def _gain(up, down, weight, ridge):
    return 2 * up * weight - (down + ridge) * weight**2


def logistic(columns: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """A weight for each column and an intercept of a logistic curve, by Newton steps; Platt's targets keep it finite.
    Weights of 1 and no intercept where labels are of one kind."""
    columns, labels = np.asarray(columns, float), np.asarray(labels, float)
    weights = np.append(np.ones(columns.shape[1]), 0.0)
    if len(labels) == 0 or labels.min() == labels.max():
        return weights
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    design = np.concatenate([columns, np.ones((len(labels), 1))], axis=1)

    def loss(weights: np.ndarray) -> float:
        z = design @ weights
        return float((np.logaddexp(0, z) - target * z).sum())

    now = loss(weights)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(design.shape[1])
        step = np.linalg.solve(hessian, design.T @ (target - p))
        # a step that makes it worse is halved
        while (after := loss(weights + step)) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        weights, now = weights + step, after
    return weights


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and intercept of a logistic curve over margins."""
    slope, intercept = logistic(np.asarray(margin, float)[:, None], labels)
    return float(slope), float(intercept)
