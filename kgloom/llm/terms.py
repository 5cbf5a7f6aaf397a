"""Terms of texts as bytes, their numbers, and sums by key.

A table of 256 bytes says what each byte of a text's UTF-8 becomes: its terms are what the table's blanks part. Only A-Z have a lower
case there; all bytes of longer characters stay. An empty text has no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are split at once.
PIECE = 1 << 20


def _table(digits: bool) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or digits and 48 <= c <= 57 else 32 for c in range(256))


#: Letters, and letters and digits; both with all characters beyond ASCII.
LETTERS, LETTERS_AND_DIGITS = _table(False), _table(True)


def term_pieces(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of ``text``, those of about ``piece`` bytes at a time."""
    at = 0
    while at < len(text):
        end = at + piece
        while end < len(text) and table[text[end]] != 32:  # on to the end of the term
            end += 1
        yield text[at:end].translate(table).split()
        at = end


class Numbers(dict):
    """Numbers of terms, in the order of their first lookup."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and each value's sum at them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)
