"""Small fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Slopes and the intercept (last) of a ridge logistic regression by Newton steps; columns are scaled inside.  One class only:
    slopes 0 and the smoothed base rate."""
    y = np.asarray(y, float)
    positive = (y.sum() + 1) / (len(y) + 2)
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return np.array([0.0] * x.shape[1] + [np.log(positive / (1 - positive))])
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    a = np.column_stack(((x - centre) / spread, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * len(y) ** 0.5)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ centre)
