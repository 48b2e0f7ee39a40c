"""Logistic regression over hashed sparse features, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Linear:
    """Weights by feature hash, and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def train(
    rows: Sequence[tuple[np.ndarray, np.ndarray, float, float]],
    size: int,
    epochs: int = 4,
    alpha: float = 0.1,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
) -> Linear:
    """rows: (distinct feature numbers, their values, label from 0 to 1, weight of the row), visited in order each epoch.

    Each coordinate has its own learning rate, from the sum of its squared gradients; coordinates whose accumulated
    gradient stays below l1 have weight zero. Without rows all scores are 0.5.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi, one = z[at], np.where(at == size, 0.0, l1)
        return np.where(np.abs(zi) <= one, 0.0, -(zi - np.sign(zi) * one) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for ids, values, label, importance in rows:
            at, x = np.append(ids, size), np.append(values, 1.0)
            w = weight(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = importance * (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Linear(w[:size].astype(np.float32), float(w[size]))
