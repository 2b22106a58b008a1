"""Linear-chain conditional random fields over many sequences at once.

Sequences stand one after another in flat arrays; the recursions step through
positions, longest sequence first, so each step is one array operation over
all sequences that reach it.
"""
from __future__ import annotations

import numpy as np


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior state probabilities of every item, and the expected transition
    counts summed over all sequences.

    score: items x states, log potentials; first: index of each sequence's
    first item, one more at the end; transition: states x states, log.
    """
    n, states = score.shape
    if n == 0:
        return np.zeros((0, states)), np.zeros((states, states))
    local = np.exp(score - score.max(1, keepdims=True))
    move = np.exp(transition - transition.max())
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    start, length = first[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # sequences with t + 1 items or more
    forward = np.empty_like(local)
    a = local[start]
    for t in range(length[0]):
        k = active[t]
        at = start[:k] + t
        if t:
            a = (a[:k] @ move) * local[at]
        a = a / a.sum(1, keepdims=True)
        forward[at] = a
    backward = np.ones((len(start), states))
    counts = np.zeros((states, states))
    out = np.empty_like(local)
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        p = forward[at] * backward[:k]
        out[at] = p / p.sum(1, keepdims=True)
        if t:
            b = local[at] * backward[:k]
            before = forward[at - 1]
            norm = ((before @ move) * b).sum(1)
            counts += (before / norm[:, None]).T @ b * move
            b = b @ move.T
            backward[:k] = b / b.sum(1, keepdims=True)
    return out, counts


class Adam:
    """Step sizes by running moments of the gradient."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient ** 2 - self.v)
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)
