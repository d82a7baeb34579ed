"""Hashes of word shingles, the same in every worker and on every machine."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"\w+").findall
#: Words in a shingle.
WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        if len(word) < 100:
            self[word] = h
        return h


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = WORDS(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """One hash for each run of ``width`` words (lower case, without punctuation), repeats included. A text of fewer words
    has one shingle of all of them, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(width, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        h = (h + w[i : len(w) - width + 1 + i]) * _STEP
    return mixed(h)
