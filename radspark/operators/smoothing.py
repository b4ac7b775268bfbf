"""Gaussian sums about many places at once.

Centres near each other share most of a window. exp(-(s - c)^2 / 2 sigma^2) is, about a middle m of theirs, exp(-(s - m)^2 / 2 sigma^2) exp(-(c - m)^2 / 2 sigma^2) exp(u), u = (s - m)(c - m) / sigma^2,
and TERMS terms of the last's series leave less than a double's precision where u is 0.19 at most: values all the centres see are summed up once for each term. The rest of a window is added one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

TERMS = 12
FEW = 32  # centres for which the series does not pay


def _direct(at: np.ndarray, x: np.ndarray, c: np.ndarray, sigma: float) -> np.ndarray:
    lo, hi = np.searchsorted(at, [c[0] - 3 * sigma, c[-1] + 3 * sigma])
    d = at[lo:hi] - c[:, None]
    seen = (d >= -3 * sigma) & (d < 3 * sigma)
    g = np.where(seen, np.exp(-(d.astype(float) ** 2) / (2 * sigma * sigma)), 0.0)
    return g @ x[:, lo:hi].T


def _weights(lo: float, hi: float, sigma: float) -> tuple[np.ndarray, int]:
    """Weights of all whole distances from lo to hi, 0 outside the window, and the first distance."""
    first = int(np.floor(lo)) - 1
    d = np.arange(first, int(np.ceil(hi)) + 2)
    return np.where((d >= -3 * sigma) & (d < 3 * sigma), np.exp(-(d.astype(float) ** 2) / (2 * sigma * sigma)), 0.0), first


def _edge(at: np.ndarray, x: np.ndarray, c: np.ndarray, first: int, last: int, weights: tuple[np.ndarray, int]) -> np.ndarray | float:
    """Sums over values first to last, which some of the centres see and others do not."""
    return weights[0][(at[first:last] - weights[1]) - c[:, None]] @ x[:, first:last].T if last > first else 0.0


def gaussian_sums(at: np.ndarray, x: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    """For rows of values x at places `at` and centres (both whole numbers, in order): a row a centre, a column a row of x, the sum over [c - 3 sigma, c + 3 sigma) of values times exp(-(s - c)^2 / 2 sigma^2)."""
    out = np.zeros((len(centres), len(x)))
    left, right = (_weights(z - sigma / 8, z + sigma / 8, sigma) for z in (-3 * sigma, 3 * sigma))
    i = 0
    while i < len(centres):
        j = int(np.searchsorted(centres, centres[i] + sigma / 8, "right"))
        if j - i < FEW:
            j = min(i + FEW, int(np.searchsorted(centres, centres[i] + 6 * sigma, "right")))
            out[i:j] = _direct(at, x, centres[i:j], sigma)
        else:
            c = centres[i:j]
            a, b, e, f = np.searchsorted(at, [c[0] - 3 * sigma, c[-1] - 3 * sigma, c[0] + 3 * sigma, c[-1] + 3 * sigma]).tolist()
            middle = (c[0] + c[-1]) / 2
            s, d = (at[b:e] - middle) / sigma, (c - middle) / sigma
            near, far = np.empty((TERMS, len(s))), np.empty((TERMS, len(d)))
            near[0], far[0] = np.exp(-(s**2) / 2), np.exp(-(d**2) / 2)
            for k in range(1, TERMS):
                near[k], far[k] = near[k - 1] * s / k, far[k - 1] * d
            out[i:j] = far.T @ (near @ x[:, b:e].T) + _edge(at, x, c, a, b, left) + _edge(at, x, c, e, f, right)
        i = j
    return out


def stretches(centres: np.ndarray, width: float) -> Iterator[tuple[int, int]]:
    """Centres by stretches of a width."""
    i = 0
    while i < len(centres):
        j = int(np.searchsorted(centres, centres[i] + width, "right"))
        yield i, j
        i = j


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
