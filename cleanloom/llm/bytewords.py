"""Words of UTF-8 bytes without a loop over words: where they are, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)  # A-Z become a-z
LOWER[65:91] += np.uint64(32)
FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for i, factor in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:size], _powers[1][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def lowered(codes: np.ndarray) -> np.ndarray:
    """``LOWER`` of all bytes, without a table."""
    return (codes + ((codes - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))).astype(np.uint64)


def edges(codes: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of all words; ``between`` marks the bytes that part them, by default ASCII white space."""
    blank = np.ones(len(codes) + 2, bool)
    if between is SPACE:
        np.logical_or(codes == 32, codes - np.uint8(9) < 5, out=blank[1:-1])
    else:
        blank[1:-1] = between[codes]
    found = np.flatnonzero(blank[1:] != blank[:-1])
    return found[::2], found[1::2]


def hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each word, from one running sum; it does not depend on where the word stands."""
    power, inverse = _power_tables(len(values) + 1)
    summed = np.zeros(len(values) + 1, np.uint64)
    np.add(values, np.uint64(1), out=summed[1:])
    summed[1:] *= power[:-1]
    np.cumsum(summed[1:], out=summed[1:])
    return mixed((summed[last] - summed[first]) * inverse[first] + (last - first).astype(np.uint64))
