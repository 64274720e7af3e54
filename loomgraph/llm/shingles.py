"""Five-word shingles of texts as sets of 64-bit numbers, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
#: Fixed odd multipliers of 64-bit mixing.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Texts to sorted arrays of distinct shingles: words are runs of letters, digits and ``_`` in lower case.

    A text of fewer than five words, but some, is one shingle; a text without words has none.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.hashes, self.find = words, WordHashes(), re.compile(r"\w+").findall

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.find(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * STEP + h[k : k + n]
        return np.unique(mixed(out))
