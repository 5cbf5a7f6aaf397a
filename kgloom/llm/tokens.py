"""Token ids by the ``tokenizers`` library, with each distinct pre-token encoded once.

``word_bpe_49k.json`` lower-cases, splits into runs of letters, single numerals and runs of other marks, and merges inside
each run only. So ids of a text are the ids of its runs, and a worker keeps the ids of runs it has met. Only texts
made of characters for which Python and the library surely agree take this way; the library encodes the others whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

#: Words kept by a worker before it forgets them: bounds its memory, not its results.
CACHE_WORDS = 900_000
_SAFE_TOP = 0x250  # below it, NFC changes nothing


def _ranges(codes: list[int]) -> str:
    return "".join(f"\\U{c:08x}" for c in codes)


_CODES = [c for c in range(_SAFE_TOP) if not (0x1C <= c <= 0x1F) and c not in (0x85, 0x130)]
_SPACE = [9, 10, 11, 12, 13, 32, 0xA0]
_LETTERS = [c for c in _CODES if unicodedata.category(chr(c)).startswith("L")]
_NUMERALS = [c for c in _CODES if unicodedata.category(chr(c)).startswith("N")]
_MARKS = [c for c in _CODES if c not in set(_SPACE) | set(_LETTERS) | set(_NUMERALS)]
_UNSAFE = re.compile(f"[^{_ranges(_CODES)}]")
_CONTROL = re.compile("[\x1c-\x1f]")
#: The split pattern of the tokenizer file, for lower-case text.
_RUNS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_ranges(_LETTERS)}]+|[{_ranges(_NUMERALS)}]|[{_ranges(_MARKS)}]+")


class _Kept:
    """Id lists by key, in one growing array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.hits = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def add(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, end = len(self.index), self.used + len(ids)
        while n + len(keys) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first * 0]), np.concatenate([self.size, self.size * 0])
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.first[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.flat[self.used : end] = ids
        self.used = end
        self.index.update(zip(keys, range(n, n + len(keys)), strict=True))

    def met(self, at: np.ndarray) -> None:
        n = len(self.index)
        self.hits = np.concatenate([self.hits, np.zeros(max(0, n - len(self.hits)), np.int64)])
        self.hits[:n] += np.bincount(at, minlength=n)

    def without_rare(self) -> _Kept:
        """Those that were met more often than half of them."""
        at = np.flatnonzero(self.hits > np.median(self.hits))
        keys, kept = list(self.index), _Kept()
        kept.add([keys[i] for i in at], self.size[at], self.ids(at))
        return kept

    def find(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, keys, _MISS), np.int64, len(keys))

    def ids(self, at: np.ndarray) -> np.ndarray:
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


_MISS = repeat(-1)
#: Characters of texts that are looked up together.
_AT_ONCE = 2_000_000


class Encoder:
    """Ids of whole texts. ``by_runs``: the file splits as ``_RUNS`` does, and each run's last token alone ends in </w>."""

    def __init__(self, path: str, by_runs: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_runs = by_runs
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.runs = _Kept(), _Kept()

    def learn_runs(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 2_000):
            part = runs[at : at + 2_000]
            new = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[new]) + 1
            assert len(ends) == len(part), "each run ends in one word-end token"
            self.runs.add(part, np.diff(ends, prepend=0), new)

    def learn_words(self, words: list[str]) -> None:
        """Words between white space, made of one run or several."""
        runs = self.runs.index
        # a word of letters is one run; only others need splitting
        plain = [w for w in words if w in runs or w.isalpha()]
        mixed = [w for w in words if not (w in runs or w.isalpha())]
        split = list(map(_RUNS.findall, mixed))
        parts = plain + list(chain.from_iterable(split))
        if new := [r for r in dict.fromkeys(parts) if r not in runs]:
            self.learn_runs(new)
        at = self.runs.find(parts)
        of = np.concatenate([np.arange(len(plain)), np.repeat(np.arange(len(plain), len(words)), np.fromiter(map(len, split), np.int64, len(split)))])
        self.words.add(plain + mixed, np.bincount(of, self.runs.size[at], len(words)).astype(np.int64), self.runs.ids(at))

    def _safe(self, text: str) -> bool:
        unsafe = _CONTROL if text.isascii() else _UNSAFE
        return self.by_runs and not unsafe.search(text) and not ("<|" in text and any(s in text for s in self.special))

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each whole text, as uint32, a few texts at a time."""
        at = 0
        while at < len(texts):
            past, size = at, 0
            while past < len(texts) and (past == at or size + len(texts[past]) <= _AT_ONCE):
                size += len(texts[past])
                past += 1
            yield from self._encode_some(texts[at:past])
            at = past

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [x.lower().split() if self._safe(x) else None for x in texts]
        words = list(chain.from_iterable(x for x in split if x))
        at = self.words.find(words)
        if (at < 0).any():
            if len(self.words.index) > CACHE_WORDS:
                self.words, self.runs = self.words.without_rare(), _Kept()
                at = self.words.find(words)
            where = np.flatnonzero(at < 0)
            new = [words[i] for i in where]
            self.learn_words(list(dict.fromkeys(new)))
            at[where] = self.words.find(new)
        self.words.met(at)
        sizes = np.concatenate([[0], np.cumsum(self.words.size[at])])
        ids, place = self.words.ids(at), 0
        for text, own in zip(texts, split, strict=True):
            if own is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[sizes[place] : sizes[place + len(own)]]
                place += len(own)

    def encode(self, text: str) -> np.ndarray:
        return next(self._encode_some([text]))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; runs are its own only for the file whose split is known."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, by_runs=path.endswith("word_bpe_49k.json"))
    return _ENCODERS[path]
