"""Words, word hashes and shingle sets on whole texts, as numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Distinct words whose hash a worker remembers; the store is emptied when full.
REMEMBERED = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text: A-Z lower-cased, split at the six ASCII white space characters."""
    words = text.lower().split()  # of bytes: ASCII rules only
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of a text with fewer words, one for all its words; of none, nothing."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * _MIX
        s ^= s >> _SHIFT
    return np.unique(s)


def set_id(shingles: np.ndarray) -> bytes:
    """96 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


class MinHash:
    """Signatures of ``size`` 16-bit minhash codes, four to a 64-bit number, the first in its highest bits."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1))[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), 0xFFFFFFFF, dtype=np.uint32)
        short = ((shingles * _MIX) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 4096):  # long texts in pieces, so that memory stays bounded
            np.minimum(low, ((short[at : at + 4096] ^ self.xor) * self.times).min(axis=1), out=low)
        codes = (low.astype(np.uint64) * _MIX) >> np.uint64(48)
        return codes.astype(">u2").view(">i8").astype(np.int64)
