"""Exact number-theoretic transforms of many rows at once, as matrix products.

Residues are kept centred as whole numbers in doubles. A product of two is
below 2^44, so sums of up to 512 stay below 2^53 and every step is exact.
"""

from __future__ import annotations

import functools

import numpy as np

PRIME = 7 * 2**20 + 1
ROOT = 3  # generator of the multiplicative group
ORDER = 1 << 20  # longest transform
DIRECT, SPLIT = 256, 32


def centred(x: np.ndarray) -> np.ndarray:
    """Residues of whole numbers below 2^53, at most half the prime in size; in place."""
    q = x * (1.0 / PRIME)
    np.rint(q, out=q)
    q *= PRIME
    x -= q
    return x


@functools.lru_cache(maxsize=None)
def powers(n: int, sign: int) -> np.ndarray:
    """w^0 .. w^(n-1) of a root of unity of order n, or of its inverse."""
    w = pow(ROOT, (PRIME - 1) // n * sign, PRIME)
    out, have = np.ones(n), 1
    while have < n:
        out[have : 2 * have] = centred(out[: min(have, n - have)] * centred(np.array([float(pow(w, have, PRIME))])))
        have *= 2
    return centred(out)


@functools.lru_cache(maxsize=None)
def matrix(n: int, sign: int) -> np.ndarray:
    k = np.arange(n)
    return powers(n, sign)[np.outer(k, k) % n]


@functools.lru_cache(maxsize=4)
def twiddle(n: int, sign: int) -> np.ndarray:
    return powers(n, sign)[np.outer(np.arange(SPLIT), np.arange(n // SPLIT)) % n]


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of every row, in an order that ``inverse`` undoes."""
    rows, n = x.shape
    if n <= DIRECT:
        return centred(x @ matrix(n, 1))
    y = centred(np.matmul(matrix(SPLIT, 1), x.reshape(rows, SPLIT, n // SPLIT)))
    y *= twiddle(n, 1)
    return forward(centred(y).reshape(rows * SPLIT, n // SPLIT)).reshape(rows, n)


def inverse(x: np.ndarray) -> np.ndarray:
    """Rows of which ``x`` is the transform, times the row length."""
    rows, n = x.shape
    if n <= DIRECT:
        return centred(x @ matrix(n, -1))
    y = inverse(x.reshape(rows * SPLIT, n // SPLIT)).reshape(rows, SPLIT, n // SPLIT)
    y *= twiddle(n, -1)
    return centred(np.matmul(matrix(SPLIT, -1), centred(y))).reshape(rows, n)


def mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences modulo the prime, of every row's block at
    every place of its window. Rows hold centred residues; windows are at most
    twice as long as blocks, so the cyclic product does not wrap at any place."""
    rows, b = blocks.shape
    w, n = windows.shape[1], 2 * b
    pad = np.zeros((2, rows, n))
    pad[0, :, :b] = blocks[:, ::-1]
    pad[1, :, :w] = windows
    product = forward(pad[0])
    product *= forward(pad[1])
    cross = inverse(centred(product))[:, b - 1 : w]
    cross *= float(pow(n, -1, PRIME)) - PRIME * (pow(n, -1, PRIME) > PRIME // 2)
    run = np.zeros((rows, w + 1))
    np.cumsum(centred(windows * windows), axis=1, out=run[:, 1:])
    out = run[:, b:] - run[:, : w - b + 1]
    out += centred(blocks * blocks).sum(axis=1, keepdims=True)
    out -= 2 * centred(cross)
    return centred(out)
