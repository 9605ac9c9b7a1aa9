"""Anchors: positions that equal stretches choose alike.

A window of ``w`` consecutive hashes chooses the position of its smallest one (the last of
equal ones). Equal windows choose the same relative position, and neighbouring windows
mostly share theirs, so few positions are chosen. Each anchor owns a run of consecutive
windows, and every window has exactly one owner.
"""

from __future__ import annotations

import numpy as np


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, windows owned) of all windows of ``w`` hashes.

    A sliding minimum by doubling: minima over spans of 1, 2, 4, ... with their positions.
    """
    n = len(h) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    low, at, span = h.copy(), np.arange(len(h)), 1
    while 2 * span <= w:
        right = low[span:] <= low[:-span]
        at = np.where(right, at[span:], at[:-span])
        low = np.where(right, low[span:], low[:-span])
        span *= 2
    shift = w - span
    if shift:
        right = low[shift:] <= low[: len(low) - shift]
        at = np.where(right, at[shift:], at[: len(at) - shift])
    at = at[:n]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.diff(np.append(first, n))


def rolling(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``k`` numbers: polynomials modulo 2**64 by prefix sums.

    Multiplying by powers of the odd base's inverse brings every run to the same power.
    """
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.empty(len(x) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(base)
    powers = np.multiply.accumulate(powers)
    inverse = np.empty(n, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[:-1], dtype=np.uint64)))
    return (sums[k:] - sums[:-k]) * inverse
