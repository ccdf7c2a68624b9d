"""Words, word shingles and MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space, tab, LF, VT, FF and CR; only A-Z are lower-cased."""
    return text.encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles_of(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingles of ``width`` words; a shorter sequence is one shingle, none has none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        out = mixed(out * np.uint64(MIX[0]) + hashes[i:n - span + 1 + i])
    return np.unique(out)


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` multiply-shift hash functions from 64 to 32 bits."""
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2**64, count, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least value of each permuted hash; all ones for an empty set."""
    least = np.full(len(a), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), block):
        x = shingles[at:at + block]
        np.minimum(least, ((x[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)
