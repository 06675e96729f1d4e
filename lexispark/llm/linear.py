"""Small linear models that are fitted on bounded samples and applied by Spark tasks."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader weights of shape (features, classes), elastic-net penalised.

    A weight is 0 until its accumulated gradient passes l1, so the model stays sparse.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def step(self, rows: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """One update of distinct rows whose weights are w."""
        n = self.n[rows]
        grown = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature that gives held-out rows the least negative log-likelihood; 1 without rows."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        move = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(ridge), gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w
