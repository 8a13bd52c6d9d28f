"""Sparse softmax regression on the driver, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[Row], targets: np.ndarray, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims x classes, many exactly 0) and biases by follow-the-regularised-leader with an elastic net.

    ``rows``: feature indices and values; ``targets``: a class distribution for each row.
    """
    classes = targets.shape[1]
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    w = np.zeros((dims + 1, classes))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            used = np.unique(np.concatenate([rows[i][0] for i in part] + [np.array([dims])]))
            x = np.zeros((len(part), len(used)))
            for r, i in enumerate(part):
                x[r, np.searchsorted(used, rows[i][0])] = rows[i][1]
                x[r, -1] = 1.0
            g = x.T @ (softmax(x @ w[used]) - targets[part]) / len(part)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w[used]
            n[used] += g * g
            shrink = np.maximum(np.abs(z[used]) - l1, 0.0)
            shrink[-1] = np.abs(z[dims])  # the bias isn't penalised
            w[used] = -np.sign(z[used]) * shrink / ((beta + np.sqrt(n[used])) / alpha + l2)
    return w[:dims], w[dims]


def logits(rows: list[Row], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([v @ w[i] + b for i, v in rows]) if rows else np.zeros((0, len(b)))


def temperature(z: np.ndarray, targets: np.ndarray) -> float:
    """The temperature at which softmax(z / t) has the least log loss."""
    if not len(z):
        return 1.0
    losses = [(-(targets * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean(), t) for t in np.geomspace(0.02, 20, 120)]
    return float(min(losses)[1])
