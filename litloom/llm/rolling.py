"""Rolling hashes over code points and words in numpy.

The hash of a span is a polynomial modulo 2**64 over mixed code points, read from prefix sums, so any word, line or
word n-gram costs a few array operations. Powers are kept for texts up to KEEP code points and made afresh beyond.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GRAM = np.uint64(0xD6E8FEB86659FD93)
KEEP = 1 << 21
_powers: list = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = 1 << max(16, n.bit_length())
    pair = _power(BASE, size), _power(INVERSE, size)
    if size <= KEEP:
        _powers[:] = pair
    return pair


class Text:
    """Code points of a text with its words ([^\\x20\\x09-\\x0D]+) and hashes of any span."""

    def __init__(self, text: str | None):
        self.codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        blank = (self.codes == 32) | ((self.codes - np.uint32(9)) <= 4)
        edge = np.empty(n + 1, np.int8)
        solid = (~blank).view(np.int8)
        if n:
            edge[0], edge[n] = solid[0], -solid[-1]
            np.subtract(solid[1:], solid[:-1], out=edge[1:n])
        else:
            edge[0] = 0
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.codes + np.uint32(1)) * up[:n], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each span [start, end)."""
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out *= GRAM
        out += words[k : k + count]
    return mixed(out)


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values stand twice or more."""
    order = np.sort(values)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(values, twice) if len(twice) else np.zeros(len(values), bool)


def covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that hits marks."""
    if not hits.any():
        return np.zeros(size, bool)
    at = np.flatnonzero(hits)
    step = np.zeros(size + 1, np.int64)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[:size]) > 0
