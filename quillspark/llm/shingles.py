"""Sets of word shingles and their minwise signatures, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

POSITIONS = 64
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**64 - 1, POSITIONS, np.uint64)
CACHE_ROWS = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ROWS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of so many words; of all its words, if fewer; none without words.

    A-Z count as a-z; words are separated by ASCII white space.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, size)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + h[i : n - k + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """At each position the upper half of the least rehashed shingle; of a set that isn't empty."""
    out = np.empty(POSITIONS, np.uint32)
    for i in range(POSITIONS):
        out[i] = ((shingles ^ _MASKS[i]) * _FACTORS[i]).min() >> np.uint64(32)
    return out


def identity(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
