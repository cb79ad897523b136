"""Shingle sets and MinHash signatures of one text, in numpy.

Words are hashed by a polynomial over their bytes modulo 2^64 and finished by a mixer, five
word hashes make a shingle hash in the same way. Two shingles that differ agree with a chance
of about 2^-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Shingles hashed at a time, so that a long text needs no large matrix.
_CHUNK = 1024


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.made = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.made) < n:
            step = np.uint64(pow(self.base, len(self.made), 1 << 64))
            self.made = np.concatenate([self.made, self.made * step])
        return self.made[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values start and end."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edges = np.diff(padded)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span of bytes, the same wherever the span lies."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS(len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _INVERSES(len(data))[starts]
    return mixed(own + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word; A-Z count as a-z."""
    data = np.frombuffer(text.lower(), np.uint8)  # bytes are lowered in ASCII only
    return span_hashes(data, *runs(~_SPACE[data]))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes, in order; with fewer words one of the whole sequence."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    count = len(words) - width + 1
    made = np.full(count, np.uint64(len(words) if width < WIDTH else 0))
    for i in range(width):
        made = made * np.uint64(_BASE) + words[i : i + count]
    return np.unique(mixed(made))


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def odd_bits(shingles: np.ndarray, words: int) -> np.ndarray:
    """64 bits per word: of the shingles that fall on a bit, whether their number is odd.

    Bits of two sets that differ each stand for a shingle that only one of them has.
    """
    at = (shingles >> np.uint64(7)) % np.uint64(64 * words)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of `count` hash functions, the same everywhere."""
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(_BASE))
    return (seeds[:count] | np.uint64(1))[:, None], seeds[count:, None]


def minima(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash of a set under every function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        hashed = shingles[None, at : at + _CHUNK] * factors + offsets
        np.minimum(least, hashed.min(axis=1), out=least)
    return least
