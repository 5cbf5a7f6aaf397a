"""Operator 4: secrets by pattern, and by a battery of randomness tests.

Base spans are pattern matches. The battery looks at every other token of ``SHORTEST`` characters or more: it infers the token's
encoding (the smallest alphabet that holds it) and takes three statistics of its symbols: chi-squared for uniform frequencies, runs
of character classes (digits, letters and odd capitals where the encoding has digits or both cases; vowels and consonants where it has
letters of one case alone), and serial correlation. Each has a p-value under written words, identifiers and numbers of that
length and encoding; the three are combined by Fisher's method. What uniform noise can't explain (one of its own p-values is below
``NOISE``) isn't random. Benjamini-Hochberg holds the share of false finds at ``RATE`` among a text's tokens of like length, so that many tokens of
other lengths don't hide a key.

Nulls: a null text counts as empty. Repeated rows give a row each. Empty tables give no row. Extra columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import id_text, map_texts
from kgloom.llm.pii import Span, listed, masked

KINDS = ("assign", "access", "hex", "random")
RATE = 2e-3
NOISE = 1e-4
SHORTEST = 16
#: Lengths up to these are one family of tests.
_FAMILIES = (23, 31, 47, 95)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Alphabets from small to large: pattern, number of symbols, and the sum of squared frequencies of its symbols in written
#: words and numbers (about 0.066 for letters of one case; less where cases and digits mix).
_ALPHABETS = ((re.compile(r"[0-9]+\Z"), 10, 0.16), (re.compile(r"[0-9a-f]+\Z"), 16, 0.12), (re.compile(r"[0-9A-F]+\Z"), 16, 0.12), (re.compile(r"(?:[a-z]+|[A-Z]+)\Z"), 26, 0.066), (re.compile(r"[A-Z2-7]+\Z"), 32, 0.066), (re.compile(r"(?:[a-z0-9]+|[A-Z0-9]+)\Z"), 36, 0.06), (re.compile(r"[A-Za-z0-9+/_-]+\Z"), 64, 0.055))
_ORDER = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")}
_NORMAL = NormalDist()
#: In written tokens: changes between digits and letters, or odd capitals, a place; changes between vowels and consonants a place; and serial
#: correlation with its spread (classes stand together in the alphabets' order).
_ODD_CHANGES, _VOWEL_CHANGES, _SERIAL = 0.07, 0.6, (0.35, 0.3)
_VOWELS = frozenset("aeiouyAEIOUY")
#: A capital that begins no word: one before a capital, digit or mark, after a lower-case letter or digit.
_ODD_CAPITAL = re.compile(r"(?<=[a-z0-9])[A-Z](?![a-z])|(?<=[a-z][A-Z])[a-z](?=[A-Z])")


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found = []
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _at_least(changes: int, expected: float) -> float:
    """The chance of so many changes or more, by Poisson's law."""
    term = total = math.exp(-expected)
    for k in range(1, changes):
        term *= expected / k
        total += term
    return min(1.0, max(1 - total, 1e-15)) if changes else 1.0


def fisher(*p: float) -> float:
    """One p-value of several independent ones."""
    half = -sum(math.log(max(x, 1e-15)) for x in p)
    term = total = 1.0
    for k in range(1, len(p)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def battery(token: str) -> tuple[float, float]:
    """(least p-value of the tests of uniform noise, combined p-value of the tests of written tokens)."""
    own = token.rstrip("=")
    alphabet = next(((k, s) for pattern, k, s in _ALPHABETS if pattern.match(own)), None)
    if not alphabet or len(own) < 12:
        return 0.0, 1.0
    k, squares = alphabet
    n = len(own)
    x = np.fromiter((_ORDER[c] for c in own), np.float64, n)
    c = np.unique(x, return_counts=True)[1]
    chi = k / n * float((c * c).sum()) - n
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = 1 - _NORMAL.cdf((chi - (k - 1)) / spread)
    above = x > np.median(x)
    hi, lo = int(above.sum()), n - int(above.sum())
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * hi * lo / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * (1 - _NORMAL.cdf(abs(runs - mean) / math.sqrt(var))) if var > 0 else 0.0
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if d.any() else 1.0
    p_serial = 2 * (1 - _NORMAL.cdf(abs(serial + 1 / (n - 1)) * math.sqrt(n)))
    # in words the expected statistic has n * (k * squares - 1) more, and a spread that follows it
    more = n * (k * squares - 1)
    even = _NORMAL.cdf((chi - (k - 1) - more) / math.sqrt(spread * spread + 4 * k * squares * more / 2))
    if k == 10:
        mixing, mixed = 1.0, 1.0
    elif k == 26:
        vowel = [v in _VOWELS for v in own]
        changes = sum(u != v for u, v in zip(vowel, vowel[1:], strict=False))
        mixing = _NORMAL.cdf((changes + 0.5 - _VOWEL_CHANGES * (n - 1)) / math.sqrt(n * _VOWEL_CHANGES * (1 - _VOWEL_CHANGES)))
        mixed = 1.0
    else:
        digit = [v.isdigit() for v in own]
        changes = sum(u != v for u, v in zip(digit, digit[1:], strict=False)) + len(_ODD_CAPITAL.findall(own))
        mixing = _at_least(changes, _ODD_CHANGES * n)
        mixed = _NORMAL.cdf((serial - _SERIAL[0]) / math.sqrt(_SERIAL[1] ** 2 + 1 / n))
    return min(uniform, p_runs, p_serial), fisher(even, mixing, mixed)


def random_spans(text: str, base: list[Span]) -> list[Span]:
    """Tokens that the battery takes for random, apart from base spans."""
    families: dict[int, list] = {}
    for m in _TOKEN.finditer(text):
        if not any(s < m.end() and m.start() < e for s, _, e in base):
            noise, written = battery(m[0])
            families.setdefault(bisect_left(_FAMILIES, m.end() - m.start()), []).append((written, noise, m.start(), m.end()))
    found = []
    for tokens in families.values():
        ranked = sorted(t for t in tokens if t[1] >= NOISE)
        k = next((k for k in range(len(ranked), 0, -1) if ranked[k - 1][0] <= RATE * k / len(tokens)), 0)
        found += [(start, 3, end) for _, _, start, end in ranked[:k]]
    return sorted(found)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, random_spans(text, base)


def find_secrets(documents: DataFrame) -> DataFrame:
    """A row a document: base counts by kind, the digest of base spans, all spans, and how many the battery added."""

    def rows(ids: list, texts: list[str]) -> dict:
        both = [all_spans(x) for x in texts]
        counts = {f"n_{kind}": [sum(s[1] == k for s in b) for b, _ in both] for k, kind in enumerate(KINDS[:3])}
        return {"doc_id": ids, **counts, "base_sha256": [hashlib.sha256(listed(b, KINDS).encode()).hexdigest() for b, _ in both], "spans": [listed(b + r, KINDS) for b, r in both], "n_random": [len(r) for _, r in both]}

    return map_texts(id_text(documents), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret in ``text_col`` replaced by its kind in brackets; nulls stay null. A column
    ``n_chars`` gets the new length where the text changed."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([x if x is None else masked(x, sum(all_spans(x), []), KINDS) for x in texts], dtype=object)

    new = {text_col: clean(F.col(text_col))}
    if "n_chars" not in documents.columns:
        return documents.withColumns(new)
    changed = documents.withColumns({"_redacted": new[text_col]})
    length = F.when(F.col("_redacted") == F.col(text_col), F.col("n_chars")).otherwise(F.length("_redacted").cast(documents.schema["n_chars"].dataType))
    names = {text_col: F.col("_redacted"), "n_chars": F.coalesce(length, F.col("n_chars"))}
    return changed.select(*(names.get(c, F.col(c)).alias(c) for c in documents.columns))
