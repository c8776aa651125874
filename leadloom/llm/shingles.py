"""Word shingles of texts as bags of 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Words whose hashes a worker keeps: some 30 MB at most.
HASHED_WORDS = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each 64-bit value (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words; all are dropped once the bound is reached, as they cost little."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_hashes = _Hashes()


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (split at white space, in lower case) of all texts, and where each text ends."""
    words: list[str] = []
    ends = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            words += text.lower().split()
        ends[i] = len(words)
    return hashes_of(words), ends


def shingles(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The shingle hashes of each text; a text of 1 to 4 words has one shingle, an empty one none."""
    out = []
    n = len(hashes)
    if n >= WORDS:
        rolled = np.zeros(n - WORDS + 1, dtype=np.uint64)
        for k in range(WORDS):
            rolled += mixed(hashes[k : n - WORDS + 1 + k] ^ _MIX[k]) * (_MIX[k] | np.uint64(1))
        rolled = mixed(rolled)
    start = 0
    for end in ends.tolist():
        size = end - start
        if size >= WORDS:
            out.append(rolled[start : end - WORDS + 1])
        elif size:
            short = np.uint64(size)
            for h in hashes[start:end]:
                short = mixed(np.array([short ^ h], dtype=np.uint64))[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        start = end
    return out


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text in order, and their counts."""
    return [np.unique(s, return_counts=True) for s in shingles(*word_hashes(texts))]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and union of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both
