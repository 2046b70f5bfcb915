"""Vectorised words, word hashes and hashes of word windows over a buffer of texts.

Hashes are polynomials modulo 2**64 taken from running sums, so a hash of any
range costs one subtraction and one multiplication by the inverse power, however
long the range is.  A 64-bit mixer ends each hash.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes of text that are hashed at once: each takes 8 bytes in several arrays, which a worker keeps for the rest of its life.
HASH_BLOCK = 1 << 17


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = table(b" \t\n\v\f\r")
#: White space and ASCII punctuation.
LOOSE = table(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + (n >> 2), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_LETTERS = _letters(7)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte range of each word, and for each text the index of its first word (n + 1 entries)."""
    n = len(data)
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = np.unique(offsets[(offsets > 0) & (offsets < n)])
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = HASH_BLOCK) -> np.ndarray:
    """A 64-bit hash of each word; words must be in order and apart."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, low + block, side="right")))
        high = int(end[last - 1])
        up, down = _BYTES(high - low)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data[low:high]] * up, dtype=np.uint64)))
        s, e = start[first:last] - low, end[first:last] - low
        out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def hash_windows(words: np.ndarray, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of each range of ``length`` words from ``first``."""
    up, down = _WORDS(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
    length = np.asarray(length)
    return mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))


def windows(pointers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of ``width`` words that lies in one text, and that text's index."""
    counts = np.maximum(np.diff(pointers) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(text)) - before[text] + pointers[:-1][text], text


def gather(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges ``values[first : first + length]``, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return values[np.arange(total) + np.repeat(first - before, length)]
