"""Follow-the-regularised-leader (FTRL-Proximal) over hashed sparse rows, for a logistic or an
ordinal (cumulative-link) loss. Runs inside a task on its share of a bounded training sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ftrl:
    """One weight per slot. Per-coordinate step alpha / (beta + sqrt(sum of squared gradients))."""

    def __init__(self, slots: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(slots), np.zeros(slots)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, i: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[i]
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - s * w
        self.n[i] = n + g * g


def fit_logistic(rows, slots: int, epochs: int, alpha=1.0, beta=0.1, l1=0.02, l2=0.1, seed=0) -> tuple[np.ndarray, float]:
    """rows: list of (y, indices, values). Returns weights and intercept."""
    f, b = Ftrl(slots, alpha, beta, l1, l2), Ftrl(1, 0.5, 1.0, 0.0, 0.0)
    one, rng = np.zeros(1, np.int64), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, i, x = rows[k]
            w, w0 = f.weights(i), b.weights(one)
            d = float(sigmoid(w @ x + w0[0]) - y)
            f.step(i, w, d * x)
            b.step(one, w0, np.array([d]))
    return f.weights(), float(b.weights(one)[0])


def cut_points(theta: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])


def fit_ordinal(rows, slots: int, grades: int, epochs: int, alpha=0.5, beta=1.0, l1=0.5, l2=0.0, rate=0.02,
                seed=0) -> tuple[np.ndarray, np.ndarray]:
    """Proportional odds: P(grade > k) = sigmoid(w.x - cut[k]), one weight vector for all cuts.

    rows: list of (grade 0..grades-1, indices, values; None: all 1). Returns weights and grades - 1 ordered cuts."""
    f, rng = Ftrl(slots, alpha, beta, l1, l2), np.random.default_rng(seed)
    theta = np.concatenate([[1.0], np.zeros(grades - 2)])
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, i, x = rows[k]
            x = np.ones(len(i)) if x is None else x
            w, cut = f.weights(i), cut_points(theta)
            s = float(w @ x)
            up = sigmoid(cut[y] - s) if y < grades - 1 else 1.0
            low = sigmoid(cut[y - 1] - s) if y else 0.0
            f.step(i, w, (1.0 - up - low) * x)
            p, g = max(up - low, 1e-9), np.zeros(grades - 1)
            if y < grades - 1:
                g[y] -= up * (1 - up) / p
            if y:
                g[y - 1] += low * (1 - low) / p
            # of the first threshold, and of each log gap
            tail = np.cumsum(g[::-1])[::-1]
            theta -= rate * np.clip(np.concatenate([[tail[0]], tail[1:] * np.exp(theta[1:])]), -5, 5)
    return f.weights(), cut_points(theta)
