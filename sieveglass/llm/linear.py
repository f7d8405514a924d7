"""Small numpy learners that several operators share."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = sigmoid(z @ beta)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * beta)
        beta = beta + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, beta


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))
