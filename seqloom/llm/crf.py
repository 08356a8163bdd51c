"""Linear-chain conditional random fields over ragged arrays.

Emissions of all sequences lie on end in one array. Forward and backward passes step through the
positions of all sequences at once: sorted by length, those still running are a prefix, and the rows of a position lie
together, so that a step works on slices. Training
maximises the conditional likelihood with full gradients; the emission gradient goes back to the caller,
who knows the features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def forward_backward(emission: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (N, K), expected transitions (K, K) and the sum of log partition functions.

    `emission` (N, K) are log potentials, `sizes` the lengths of the sequences (0 allowed).
    """
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels)), 0.0
    top = emission.max(axis=1, keepdims=True)
    move = np.exp(transition)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    # The rows of one step stand together, in the order of the sequences' lengths.
    running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    begins = np.cumsum(running) - running
    step = np.repeat(np.arange(len(running)), running)
    rank = np.arange(n) - begins[step]
    source = first[rank] + step
    e = np.exp(emission - top)[source]
    forward, scale = np.empty_like(e), np.empty((n, 1))
    bounds = [*begins.tolist(), n]
    for t, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        a, s = forward[lo:hi], scale[lo:hi]
        if t:
            before = bounds[t - 1]
            np.matmul(forward[before : before + hi - lo], move, out=a)
            a *= e[lo:hi]
        else:
            a[:] = e[lo:hi]
        np.add.reduce(a, axis=1, keepdims=True, out=s)
        a /= s
    backward, inner, turned = np.ones_like(e), e / scale, np.ascontiguousarray(move.T)
    for t in range(len(running) - 1, 0, -1):
        lo, hi, before = bounds[t], bounds[t + 1], bounds[t - 1]
        inner[lo:hi] *= backward[lo:hi]
        np.matmul(inner[lo:hi], turned, out=backward[before : before + hi - lo])
    later = slice(running[0], n)
    expected = forward[begins[step[later] - 1] + rank[later]].T @ inner[later]
    forward *= backward
    marginal = np.empty_like(e)
    marginal[source] = forward / forward.sum(axis=1, keepdims=True)
    return marginal, expected * move, float(np.log(scale).sum() + top.sum())


def fitted(
    emissions: Callable[[np.ndarray], np.ndarray],
    gradient: Callable[[np.ndarray], np.ndarray],
    shape: tuple[int, int],
    gold: np.ndarray,
    sizes: np.ndarray,
    steps: int,
    rate: float,
    penalty: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, K) and transitions (K, K) by Adam on the penalised log likelihood.

    `emissions(weights)` gives the log potentials; `gradient(d)` turns their gradient into the weights'.
    """
    n, labels = len(gold), shape[1]
    weights, transition = np.zeros(shape), np.zeros((labels, labels))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[1:] == owner[:-1]
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[:-1][inside], gold[1:][inside]), 1)
    moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in (weights, transition)]
    for step in range(1, steps + 1):
        marginal, expected, _ = forward_backward(emissions(weights), sizes, transition)
        d = -marginal
        d[np.arange(n), gold] += 1
        pulls = (gradient(d) / n - penalty * weights, (seen - expected) / n - penalty * transition)
        for value, pull, (m, v) in zip((weights, transition), pulls, moments):
            m += 0.1 * (pull - m)
            v += 0.01 * (pull * pull - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return weights, transition
