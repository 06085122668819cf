"""Word shingles of whole texts and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
#: Coordinates of a signature.
COORDINATES = 64

_rng = np.random.default_rng(20240611)
_POSITION = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)[:, None]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; very long words are hashed each time."""

    bound = 150_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a UTF-8 text: A-Z lower-cased, words between ASCII white space;
    with fewer words than a shingle has, the whole sequence is the one shingle; without words, none."""
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    m = n - WIDTH + 1
    s = h[:m] * _POSITION[0]
    for i in range(1, WIDTH):
        s += h[i : i + m] * _POSITION[i]
    s = _mix(s)
    s.sort()
    keep = np.empty(m, bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 32-bit minima of the coordinates' permutations."""
    best = np.full(COORDINATES, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[None, at : at + 1024] * _A
        part += _B
        np.minimum(best, part.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def class_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
