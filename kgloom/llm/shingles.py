"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker keeps before it forgets them: bounds its memory, not its results.
KEPT_WORDS = 800_000
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values are unlike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z alone, which is what bytes do."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row; with fewer words, of all as one; none for none."""
    if not len(words):
        return words
    own = min(n, len(words))
    return window_hashes_at(words, np.arange(len(words) - own + 1), own)


def window_hashes_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each start on."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total += words[starts + k] * _ODD[k]
    return mixed(total + _ODD[-n])


def shingle_set(text: str, n: int) -> np.ndarray:
    """The distinct shingles, ascending."""
    return np.unique(window_hashes(word_hashes(text), n))
