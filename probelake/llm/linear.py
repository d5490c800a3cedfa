"""Small linear models in numpy: logistic loss by Adam, and a Platt scale for held-out scores."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b): sigmoid(a * z + b) fits labels y, with the usual smoothed targets; a stays positive."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    mean, spread = z.mean(), z.std() + 1e-9
    x, t = (z - mean) / spread, np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton steps, damped
        p = sigmoid(a * x + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-6)
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        ga, gb = (g * x).sum() + 1e-3 * (a - 1), g.sum()
        a -= 0.5 * (hbb * ga - hab * gb) / det
        b -= 0.5 * (haa * gb - hab * ga) / det
        a = max(a, 1e-3)
    return a / spread, b - a * mean / spread
