"""The binary (23, 12) Golay code, vectorised.

The code is perfect: every 23-bit word lies within distance 3 of exactly one
codeword. neighbour_keys gives the 12-bit indices of the codewords that a word
and its 23 neighbours decode to: one if the word is within 2 of its codeword,
six otherwise. Words at distance 2 or less have a common neighbour (or are
neighbours), so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
BITS, CHECK = 23, 11


def _remainder(v: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 12 bits, and the error of each syndrome."""
    unit = [_remainder(1 << i) for i in range(BITS)]
    high = np.zeros(1 << 12, np.int64)
    for i in range(12):
        high[np.arange(1 << 12) >> i & 1 == 1] ^= unit[i + CHECK]
    error = np.zeros(1 << CHECK, np.int64)
    for n in range(1, 4):
        for at in combinations(range(BITS), n):
            s = 0
            for i in at:
                s ^= unit[i]
            error[s] = sum(1 << i for i in at)
    return high, error, np.array([0, *(1 << i for i in range(BITS))], np.int64)


HIGH, ERROR, FLIPS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each 23-bit word."""
    syndrome = HIGH[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    return (words ^ ERROR[syndrome]) >> CHECK


def neighbour_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the distinct codeword indices near each word."""
    keys = np.sort(decode(words[:, None] ^ FLIPS[None, :]), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, col = np.nonzero(new)
    return row, keys[row, col]
