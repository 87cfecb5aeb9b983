"""A random forest, fitted in numpy on the driver and applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ForestSize:
    trees: int = 16
    depth: int = 7
    least_leaf: int = 4
    seed: int = 5


def _leaf(y: np.ndarray) -> float:
    return float(y.mean())


def _grow(x: np.ndarray, y: np.ndarray, depth: int, size: ForestSize, random: np.random.Generator):
    """A leaf's share of positives, or (feature, threshold, lower, upper)."""
    if depth == 0 or len(y) < 2 * size.least_leaf or y.min() == y.max():
        return _leaf(y)
    best = (np.inf, 0, 0.0)
    for f in random.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 1)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        left = np.cumsum(t)[:-1]
        right = t.sum() - left
        m = len(t) - n
        gini = left * (1 - left / n) + right * (1 - right / m)
        gini[(v[1:] == v[:-1]) | (n < size.least_leaf) | (m < size.least_leaf)] = np.inf
        k = int(np.argmin(gini))
        if gini[k] < best[0]:
            best = (gini[k], int(f), float((v[k] + v[k + 1]) / 2))
    if not np.isfinite(best[0]):
        return _leaf(y)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], depth - 1, size, random), _grow(x[~low], y[~low], depth - 1, size, random)


def fit(x: np.ndarray, y: np.ndarray, size: ForestSize = ForestSize()) -> list:
    """Trees over bootstrap samples of the rows, each split over a random subset of the features."""
    random = np.random.default_rng(size.seed)
    out = []
    for _ in range(size.trees):
        rows = random.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), size.depth, size, random))
    return out


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    """Mean share of positives; for tests."""

    def walk(node, row):
        while not isinstance(node, float):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return np.array([np.mean([walk(t, r) for t in trees]) for r in x])


def to_sql(trees: list, names: list[str]) -> str:
    """The forest as a SQL expression over feature columns."""

    def one(node) -> str:
        if isinstance(node, float):
            return f"{node:.6f}D"
        f, at, low, high = node
        return f"CASE WHEN `{names[f]}` <= {at!r}D THEN {one(low)} ELSE {one(high)} END"

    return "(" + " + ".join(one(t) for t in trees) + f") / {len(trees)}D"
