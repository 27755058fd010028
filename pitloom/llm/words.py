"""Words and shingles as 64-bit numbers, vectorised for Arrow batches inside tasks. A word is a run of `[^\\x20\\x09-\\x0D]`."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Words that a worker keeps with their hash; the table is emptied when full.
WORDS = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six ASCII white space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A number for each run of `size` words; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        total = mix(total + hashes[j : n - size + 1 + j]) * U(0x9E3779B97F4A7C15)
    return mix(total + U(size))


def counted(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(items, return_counts=True)
