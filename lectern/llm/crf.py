"""Linear-chain conditional random fields in numpy: many sequences at once, in lockstep.

Sequences lie end to end in one array, longest first in each step, so that a
step is one small matrix product over all sequences still running.
"""

from __future__ import annotations

import numpy as np


class Lattice:
    """Where the items of sequences of the given lengths stand; shared by the passes over one batch."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        # sequences that are longer than t
        self.active = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(longest), "right")
        follows = np.ones(int(lengths.sum()), bool)
        follows[starts[lengths > 0]] = False
        self.follows = np.flatnonzero(follows)


def forward_backward(emit: np.ndarray, lattice: Lattice, trans: np.ndarray, start: np.ndarray):
    """Scaled forward and backward scores, potentials, and the log-likelihood's normaliser."""
    top = emit.max(1, keepdims=True) if len(emit) else emit[:, :1]
    psi = np.exp(emit - top)
    a = np.exp(trans).astype(psi.dtype)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    log_z = float(top.sum())
    state = None
    for t, n in enumerate(lattice.active):
        at = lattice.starts[:n] + t
        state = (state[:n] @ a if t else np.exp(start).astype(psi.dtype)) * psi[at]
        scale = state.sum(1, keepdims=True)
        state = state / scale
        alpha[at] = state
        log_z += float(np.log(scale).sum())
    back, at = None, None
    for t in range(len(lattice.active) - 1, -1, -1):
        n = lattice.active[t]
        here = np.ones((n, psi.shape[1]), psi.dtype)
        if back is not None:
            step = (back * psi[at]) @ a.T
            here[: len(step)] = step / step.sum(1, keepdims=True)
        at = lattice.starts[:n] + t
        beta[at] = here
        back = here
    return alpha, beta, psi, log_z


def marginals(emit: np.ndarray, lattice: Lattice, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probability of each label for each item, given its whole sequence."""
    if not len(emit):
        return emit
    alpha, beta, _, _ = forward_backward(emit, lattice, trans, start)
    both = alpha * beta
    return both / both.sum(1, keepdims=True)


def gradients(emit: np.ndarray, labels: np.ndarray, lattice: Lattice, trans: np.ndarray, start: np.ndarray):
    """Log-likelihood and its gradients by emission scores, transitions and start scores."""
    alpha, beta, psi, log_z = forward_backward(emit, lattice, trans, start)
    node = alpha * beta
    node /= node.sum(1, keepdims=True)
    n = emit.shape[1]
    first = lattice.starts[lattice.lengths > 0]
    cur = lattice.follows
    prev = cur - 1
    pair = alpha[prev][:, :, None] * np.exp(trans)[None] * (psi * beta)[cur][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    want_pair = np.bincount(labels[prev] * n + labels[cur], minlength=n * n).reshape(n, n)
    one = np.eye(n)[labels]
    gold = emit[np.arange(len(labels)), labels].sum() + (trans * want_pair).sum() + start[labels[first]].sum()
    return gold - log_z, one - node, want_pair - pair.sum(0), (one - node)[first].sum(0)


class Adam:
    """Gradient ascent with per-weight step sizes (Kingma and Ba, 2015)."""

    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, **pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.t += 1
        for name, (weight, slope) in pairs.items():
            m, v = self.state.setdefault(name, (np.zeros_like(weight), np.zeros_like(weight)))
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            weight += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
