"""Two-state chains as products of 2 x 2 matrices, over whole streams of tokens at once."""

from __future__ import annotations

import numpy as np

#: Steps of a block: blocks advance side by side, then join in order.
BLOCK = 128


def ratios(m: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """m: entries 00, 01, 10, 11 of one matrix per step. The ratio of the second to the first component of (1, 1) M1 ... Mt, for
    each t. Exact for chains of any length: a matrix with equal rows begins a new chain."""
    n = len(m[0])
    k = -(-n // BLOCK)
    fill = [1.0, 0.0, 0.0, 1.0]
    a00, a01, a10, a11 = (np.ascontiguousarray(np.append(x, np.full(k * BLOCK - n, f)).reshape(k, BLOCK).T) for x, f in zip(m, fill, strict=True))
    a, b, c, d = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for j in range(BLOCK):
        x00, x01, x10, x11 = a00[j], a01[j], a10[j], a11[j]
        a, b, c, d = a * x00 + b * x10, a * x01 + b * x11, c * x00 + d * x10, c * x01 + d * x11
        if j % 8 == 7:
            s = a + b + c + d
            a, b, c, d = a / s, b / s, c / s, d / s
    into, r = np.empty(k), 1.0
    for i, (p, q, u, v) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[i] = r
        r = (q + r * v) / (p + r * u)
    out, r = np.empty((BLOCK, k)), into
    for j in range(BLOCK):
        r = (a01[j] + r * a11[j]) / (a00[j] + r * a10[j])
        out[j] = r
    return out.T.ravel()[:n]


def marginals(psi: np.ndarray, first: np.ndarray, a: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward. psi: potential of state 1 against state 0 at each token; first: whether a text begins there; a: transition
    potentials; begin: initial ones. Returns the probability of state 1, and the forward and backward ratios."""
    new = lambda x, y: np.where(first, x, y)
    one = np.ones_like(psi)
    forward = ratios((new(begin[0], a[0, 0]) * one, new(begin[1], a[0, 1]) * psi, new(begin[0], a[1, 0]) * one, new(begin[1], a[1, 1]) * psi))
    # Backward: the step from t to t - 1 uses the potential at t; before a text's last token stands nothing.
    ends = np.append(first[1:], True)[::-1]
    x = np.append(psi[1:], 1.0)[::-1]
    end = lambda y: np.where(ends, 1.0, y)
    backward = ratios((end(a[0, 0] * np.ones_like(x)), end(a[1, 0] * np.ones_like(x)), end(a[0, 1] * x), end(a[1, 1] * x)))[::-1]
    odds = forward * backward
    return odds / (1 + odds), forward, backward
