"""Follow-the-regularised-leader updates over hashed features, shard by shard."""

from __future__ import annotations

import numpy as np


class Leader:
    """Per-coordinate proximal follow-the-regularised-leader state (L1 and L2) over `size` hashed features and a bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Current weights; the bias (last) is not shrunk."""
        z, n = self.z[at], self.n[at]
        bias = np.zeros(len(self.z), bool)
        bias[-1] = True
        l1 = np.where(bias[at], 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """`at` must not repeat an index."""
        grown = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * weights
        self.n[at] = grown


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
