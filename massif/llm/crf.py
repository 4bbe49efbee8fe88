"""A linear-chain conditional random field with two states, over many chains at once.

Positions have a fixed number of feature indices; a chain is a run of positions. Training
maximises the conditional likelihood of labelled chains; marginals are exact, by the forward
and backward recursions, which step through all chains together, the longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = 15.0


@dataclass
class Chains:
    """Chains laid out one after another: first position and length of each."""

    start: np.ndarray
    length: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(-self.length, kind="stable")
        self.first = self.start[order]
        sizes = self.length[order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
        inner = np.ones(int(self.length.sum()), bool)
        inner[self.start + self.length - 1] = False
        self.before = np.flatnonzero(inner)  # positions that have a next one in their chain


@dataclass
class ChainModel:
    """Weights by feature index; transition scores between states; scores of the first state."""

    weights: np.ndarray
    transition: np.ndarray
    initial: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return np.clip(out, -LIMIT, LIMIT)

    def _passes(self, emission: np.ndarray, chains: Chains) -> tuple[np.ndarray, ...]:
        n = len(emission)
        gain, m = np.exp(emission), np.exp(self.transition)
        a, b = np.empty((2, n)), np.ones((2, n))
        p0 = p1 = None
        for t, alive in enumerate(chains.alive):
            at = chains.first[:alive] + t
            if t == 0:
                q0, q1 = np.full(alive, np.exp(self.initial[0])), np.exp(self.initial[1]) * gain[at]
            else:
                p0, p1 = p0[:alive], p1[:alive]
                q0, q1 = p0 * m[0, 0] + p1 * m[1, 0], (p0 * m[0, 1] + p1 * m[1, 1]) * gain[at]
            total = q0 + q1
            p0, p1 = q0 / total, q1 / total
            a[0, at], a[1, at] = p0, p1
        for t in range(len(chains.alive) - 2, -1, -1):
            at = chains.first[: chains.alive[t + 1]] + t
            u0, u1 = b[0, at + 1], b[1, at + 1] * gain[at + 1]
            q0, q1 = m[0, 0] * u0 + m[0, 1] * u1, m[1, 0] * u0 + m[1, 1] * u1
            total = q0 + q1
            b[0, at], b[1, at] = q0 / total, q1 / total
        return a, b, gain, m

    def marginals(self, features: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of state 1 at every position."""
        if not len(features):
            return np.zeros(0)
        a, b, _, _ = self._passes(self.emissions(features), chains)
        one = a[1] * b[1]
        return one / (a[0] * b[0] + one)


def fit_chains(features: np.ndarray, chains: Chains, state: np.ndarray, size: int, steps: int = 60, rate: float = 0.15, ridge: float = 1.0) -> ChainModel:
    """Fit by adaptive-moment gradient steps on the log-likelihood, with a ridge."""
    model = ChainModel(np.zeros(size, np.float32), np.zeros((2, 2)), np.zeros(2))
    if not len(features):
        return model
    used, compact = np.unique(features, return_inverse=True)
    compact = compact.reshape(features.shape)
    small = ChainModel(np.zeros(len(used)), model.transition, model.initial)
    n, y = len(features), state.astype(np.float64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[chains.before].astype(int), state[chains.before + 1].astype(int)), 1)
    heads = np.bincount(state[chains.start].astype(int), minlength=2).astype(float)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    small.initial = np.array([0.0, np.log(share / (1 - share))])
    flat = [small.weights, small.transition.ravel(), small.initial]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in flat]
    for step in range(1, steps + 1):
        a, b, gain, m = small._passes(small.emissions(compact), chains)
        one = a[1] * b[1]
        p = one / (a[0] * b[0] + one)
        i, j = chains.before, chains.before + 1
        pairs = np.stack([a[s, i] * m[s, e] * (gain[j] if e else 1.0) * b[e, j] for s in (0, 1) for e in (0, 1)])
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1) if len(i) else np.zeros(4)
        start = np.array([(1 - p[chains.start]).sum(), p[chains.start].sum()])
        miss = y - p
        slope = np.zeros(len(used))
        for k in range(compact.shape[1]):
            slope += np.bincount(compact[:, k], miss, len(used))
        slopes = [slope, seen.ravel() - expected, heads - start]
        for x, g, (m1, m2) in zip(flat, slopes, moments, strict=True):
            g = (g - ridge * x) / n
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        small.transition, small.initial = flat[1].reshape(2, 2), flat[2]
    model.weights[used] = small.weights
    return ChainModel(model.weights, small.transition.copy(), small.initial.copy())


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients (the constant first) of a ridge logistic regression, by Newton steps; label 1 weighs ``share`` in all."""
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = logistic(x @ beta)
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))
