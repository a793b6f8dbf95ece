"""Hashes of word shingles, many words at a time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_CHUNK = 50_000  # words hashed at once; memory does not grow with the text
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, dict]:
    draw = np.random.default_rng(11)
    return draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse (modulo 2^64), at least n of them."""
    known = _tables()[1]
    if len(known.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            factors = np.full(size, base)
            factors[0] = 1
            known[name] = np.multiply.accumulate(factors)
    return known["up"][:n], known["down"][:n]


def words_of(text: str) -> list[bytes]:
    """Words between the characters 0x20 and 0x09-0x0D, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_tables()[0][data] * up[:-1], out=sums[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - width + 1], ends[width - 1 :]
    h = (sums[last] - sums[first]) * down[first]
    # Mix the bits: the sums alone are weak in the low ones.
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, none has none."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        parts = [_hashes(words[i : i + _CHUNK + width - 1], width) for i in range(0, len(words) - width + 1, _CHUNK)]
    return np.unique(np.concatenate(parts))


def sequence_key(words: list[bytes]) -> bytes:
    """The same for texts with the same words in the same order."""
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
