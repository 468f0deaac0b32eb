"""Histogram gradient-boosted trees for a binary label: fitted on a bounded sample, scored with flat arrays."""

from __future__ import annotations

import numpy as np

#: Bins of a feature.
BINS = 64


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> dict:
    """Complete trees of `depth` levels as arrays [tree, inner node] of features and thresholds, and [tree, leaf] values.

    Each level adds up gradient and curvature histograms of all its nodes at once and takes the best cut of each; a
    node without a gain gets a threshold of infinity, so all its rows go left."""
    n, f = x.shape
    edges = _edges(x) if n else [np.zeros(0)] * f
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if n else np.zeros((0, f), dtype=np.int64)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-4), 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(rounds if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, dtype=np.int32), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, at_feature, at_bin = np.zeros(width), np.full(width, -1), np.zeros(width, dtype=np.int64)
            for j in range(f):
                cell = node * BINS + bins[:, j]
                g, h = (np.cumsum(np.bincount(cell, weights=w, minlength=width * BINS).reshape(width, BINS), axis=1) for w in (grad, curve))
                total, weight = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (total - g) ** 2 / (weight - h + l2) - total**2 / (weight + l2)
                gain[(h < least) | (weight - h < least)] = 0
                k = gain.argmax(axis=1)
                won = gain[np.arange(width), k] > best + 1e-9
                best = np.where(won, gain[np.arange(width), k], best)
                at_feature, at_bin = np.where(won, j, at_feature), np.where(won, k, at_bin)
            for w in range(width):
                if at_feature[w] >= 0 and at_bin[w] < len(edges[at_feature[w]]):
                    feature[first + w], threshold[first + w] = at_feature[w], edges[at_feature[w]][at_bin[w]]
            node = 2 * node + (x[np.arange(n), feature[first + node]] > threshold[first + node])
        g, h = (np.bincount(node, weights=w, minlength=1 << depth) for w in (grad, curve))
        value = rate * g / (h + l2)
        score += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return {"base": base, "depth": depth, "feature": np.array(features), "threshold": np.array(thresholds), "value": np.array(values)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every row, walking all rows down one tree at a time."""
    score, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += value[node - ((1 << model["depth"]) - 1)]
    return 1 / (1 + np.exp(-score))
