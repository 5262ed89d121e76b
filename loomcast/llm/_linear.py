"""Follow-the-regularised-leader (proximal) for sparse linear models, in numpy."""

from __future__ import annotations

import numpy as np


class FTRL:
    """Per-coordinate adaptive steps; ``l1`` keeps weights at exactly zero, ``l2`` shrinks the rest (elastic net)."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if ids is None else (self.z[ids], self.n[ids])
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, ids: np.ndarray, values: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One example: softmax over the classes against the target distribution."""
        w = self.weights(ids)
        logits = values @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        g = np.outer(values, p - target) * weight
        more = np.sqrt(self.n[ids] + g * g)
        self.z[ids] += g - (more - np.sqrt(self.n[ids])) / self.alpha * w
        self.n[ids] += g * g
