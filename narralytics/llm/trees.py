"""Gradient-boosted trees for a logistic loss on a small weighted table; used to fit, never to score at scale."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# a tree is a number (leaf) or (feature, limit, tree where value <= limit, tree elsewhere)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3,
        bins: int = 24, ridge: float = 1.0) -> tuple[float, list]:
    """(base, trees) of a boosted classifier; splits lie between binned values."""
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(limit, c, side="left") for limit, c in zip(limits, x.T)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        values = np.zeros(len(y))

        def grow(rows, level):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) > 1:
                for f, limit in enumerate(limits):
                    if len(limit) < 2:
                        continue
                    size = len(limit) + 1
                    left_g = np.cumsum(np.bincount(codes[rows, f], g[rows], size))[:-1]
                    left_h = np.cumsum(np.bincount(codes[rows, f], h[rows], size))[:-1]
                    gain = left_g ** 2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs ** 2 / (hs + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k)
            if best is None:
                leaf = float(rate * gs / (hs + ridge))
                values[rows] = leaf
                return leaf
            _, f, k = best
            low = codes[rows, f] <= k
            return f, float(limits[f][k]), grow(rows[low], level + 1), grow(rows[~low], level + 1)

        trees.append(grow(np.arange(len(y)), 0))
        total += values
    return base, trees


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    """Log-odds of every row."""
    base, trees = model
    out = np.full(len(x), base)

    def add(tree, rows):
        if isinstance(tree, tuple):
            f, limit, low, high = tree
            left = x[rows, f] <= limit
            add(low, rows[left])
            add(high, rows[~left])
        else:
            out[rows] += tree

    for tree in trees:
        add(tree, np.arange(len(x)))
    return out


def expression(model: tuple[float, list], feature) -> Column:
    """Log-odds as a Spark expression; ``feature(k)`` is the column of feature k."""
    base, trees = model

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, limit, low, high = tree
        return F.when(feature(f) <= limit, of(low)).otherwise(of(high))

    total = F.lit(float(base))
    for tree in trees:
        total = total + of(tree)
    return total
