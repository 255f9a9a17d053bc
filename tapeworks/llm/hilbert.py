"""Positions on a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of points with ``bits`` bits in each column of ``cells``; columns x bits is at most 63.

    The walk goes from the coarsest bit to the finest. At each level the point's sub-cube is found in Gray-code order
    and the finer bits are reflected and exchanged so that the curve stays connected.
    """
    axes = np.array(cells, dtype=np.int64).T.copy()
    n, count = axes.shape
    if n * bits > 63:
        raise ValueError(f"{n} columns of {bits} bits do not fit a long")
    for level in range(bits - 1, 0, -1):
        bit, finer = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(n):
            high = (axes[i] & bit) != 0
            exchange = np.where(high, 0, (axes[0] ^ axes[i]) & finer)
            axes[0] ^= np.where(high, finer, exchange)
            axes[i] ^= exchange if i else 0
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(count, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[n - 1] & (1 << level), (1 << level) - 1, 0)
    axes ^= turn
    index = np.zeros(count, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((axes[i] >> level) & 1)
    return index
