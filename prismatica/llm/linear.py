"""Small helpers for linear models over the presence of hashed text features."""

from __future__ import annotations

import sys

import numpy as np

from prismatica.llm.common import ship

ship(sys.modules[__name__])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fitted(rows: np.ndarray, cols: np.ndarray, n: int, width: int, dense: np.ndarray, target: np.ndarray,
           penalty: float = 1e-4, rounds: int = 150, weight: np.ndarray | None = None, intercept: bool = True):
    """Logistic regression with L2 penalty on sparse presence features (rows, cols) and dense
    columns, by Adam on the whole sample. Gives sparse weights, dense weights and intercept."""
    w = np.zeros(width + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + dense @ w[width:-1] + w[-1]
        r = (sigmoid(z) - target) * weight
        g = np.concatenate([np.bincount(cols, r[rows], width), dense.T @ r, [r.sum() if intercept else 0.0]])
        g[:-1] += penalty * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:width], w[width:-1], float(w[-1])


def telling(hashes: np.ndarray, rows: np.ndarray, target: np.ndarray, most: int) -> np.ndarray:
    """The features whose presence differs most between the two classes, by the z value of the
    log odds ratio; sorted hashes, at most ``most``."""
    values, place = np.unique(hashes, return_inverse=True)
    ones = np.bincount(place, target[rows], len(values))
    zeros = np.bincount(place, 1.0 - target[rows], len(values))
    n1, n0 = target.sum(), (1.0 - target).sum()
    odds = np.log((ones + 0.5) / (n1 - ones + 0.5)) - np.log((zeros + 0.5) / (n0 - zeros + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (ones + 0.5) + 1 / (n1 - ones + 0.5) + 1 / (zeros + 0.5) + 1 / (n0 - zeros + 0.5))
    z[ones + zeros < 3] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(values[best[z[best] > 2.5]])
