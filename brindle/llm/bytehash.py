"""Vectorised byte hashing: rolling window hashes of whole buffers and window minima."""

from __future__ import annotations

import numpy as np

#: Two independent families of hashes: a base and a fixed random value per byte value for each.
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_VALUES = tuple(np.random.Generator(np.random.PCG64(k)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (7, 19))
_POWERS = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept for the next call."""
    if len(_POWERS[family][0]) < n:
        size, base = 1 << (n - 1).bit_length(), _BASES[family]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        with np.errstate(over="ignore"):
            _POWERS[family] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]), dtype=np.uint64) for b in (base, inverse))
    return _POWERS[family][0][:n], _POWERS[family][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Prefix sums of a buffer, from which the hash of any slice follows in one step."""

    def __init__(self, data: np.ndarray, family: int = 0):
        up, self._down = _powers(len(data) + 1, family)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[family][data] * up[:-1], out=self._sum[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sum[stop] - self._sum[start]) * self._down[start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window at each start."""
        n = len(self._sum) - size
        return mix((self._sum[size:] - self._sum[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def word_bounds(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of word bytes; ``is_word`` is a table over byte values."""
    inside = np.concatenate([[False], is_word[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Bytes of words parted by ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of letters, digits and all characters beyond ASCII.
LETTERED = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
