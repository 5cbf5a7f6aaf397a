"""Operator 3: offset-preserving deobfuscation and detection of personal data.

Two transducers rewrite a text and keep, for each character they write, the source characters it came from. The first
maps homoglyphs and wide or styled letters and digits to ASCII and drops invisible characters; the second undoes at/dot
disguises and spelled digits. Detectors run over the source (base spans) and over the rewritten text; what they find there
is mapped back, and added where it meets no base span of its kind. Offsets are code points, the end exclusive.

Nulls: a null text counts as empty. Repeated rows give a row each. Empty tables give no row. Extra columns are ignored.
Texts are read whole; every pattern passes over a text in linear time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from kgloom.llm.common import id_text, map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of its kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            found.append((start, 0, last))
        at = text.find("@", max(last, at + 1))
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


# Letters of other scripts that look like ASCII letters, each followed by the letter it stands for.
_LOOKALIKES = "аaвbсcеeнhіiјjкkмmоoрpѕsтtуyхxԁdԛqԝwҺhАAВBСCЕEНHІIЈJКKМMОOРPЅSТTУYХXαaεeιiκkνvοoρpτtυuχxΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXıiɡgɑaⅼlⅰiⅴvⅽcⅾdⅿm"
_MARKS = "＠@﹫@．.。.․.﹒.＋+－-‐-‑-‒-–-—-−-＿_"
_HIDDEN = "​‌‍⁠﻿­‎‏"


def _char_table() -> dict[int, str]:
    """ASCII for one character: lookalikes, and letters and digits whose compatibility form is one ASCII one."""
    table = {ord(c): "" for c in _HIDDEN}
    pairs = _LOOKALIKES + _MARKS
    table |= {ord(pairs[k]): pairs[k + 1] for k in range(0, len(pairs), 2)}
    blocks = [(0xFF10, 0xFF5B), (0x1D400, 0x1D800), (0x2460, 0x249C), (0x24B6, 0x24EA), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970)]
    for lo, hi in blocks:
        for c in range(lo, hi):
            own = unicodedata.normalize("NFKC", chr(c))
            if len(own) == 1 and own.isascii() and own.isalnum():
                table[c] = own
            elif (d := unicodedata.decimal(chr(c), None)) is not None:
                table[c] = str(d)
    return table


_CHARS = _char_table()
#: All characters of the table and some others, in few ranges: a quick look before the exact one.
_MAY_BE_ODD = re.compile("[\u00ad\u0131\u0250-\U0001ffff]")
assert all(_MAY_BE_ODD.match(chr(c)) for c in _CHARS if c > 127)
_ODD_CHARS = re.compile("[" + "".join(map(chr, _CHARS)).replace("-", "\\-") + "]")

# Spelled digits in the four languages of the corpus.
_SPELLED = {w: d for d, words in {"0": "zero oh cero null zéro", "1": "one uno eins un", "2": "two dos zwei deux", "3": "three tres drei trois", "4": "four cuatro vier quatre", "5": "five cinco fünf cinq", "6": "six seis sechs", "7": "seven siete sieben sept", "8": "eight ocho acht huit", "9": "nine nueve neun neuf"}.items() for w in words.split()}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_UNIT = rf"(?:{_WORD}|[0-9])"
#: Ten digits or more in a row of which some are spelled, with "plus" before and a phone number's separators between.
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+)[ (-]{{0,2}})?{_UNIT}(?:[ ,().-]{{0,3}}{_UNIT}){{9,}}(?!\w)")
#: A spelled digit beside another digit, spelled or not: without one there is no run.
_SPELLED_TWO = re.compile(rf"(?<![^\W0-9])(?:{_WORD})[ ,().-]{{1,3}}{_UNIT}|(?<=[0-9])[ ,().-]{{1,3}}(?:{_WORD})")
_SPELLED_ONE = re.compile(rf"(?i)plus|\+|{_WORD}|[0-9]")
_AT = re.compile(r"(?i) ?[\[({<] ?(?:at|ät|arroba|arobase|@) ?[\])}>] ?")
_DOT = re.compile(r"(?i) ?[\[({<] ?(?:dot|punto|punkt|point|\.) ?[\])}>] ?")
_SPACED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at |@| @ )[A-Za-z0-9-]++(?:(?: dot |\.| \. )[A-Za-z0-9-]++)++")
_UNDERSCORED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+-]++_at_[A-Za-z0-9-]++(?:(?:_dot_|\.)[A-Za-z0-9-]++)++")
_UNDERSCORED_PART = re.compile(r"(?i)_at_|_dot_")
# Last labels of addresses that are taken for one even when "at" and "dot" are words between spaces.
_LABELS = frozenset("com org net edu gov mil int info biz io ai app dev co me tv de fr es uk it nl at ch be pl pt se no dk fi eu us ca mx br ar cl ru cn jp in au nz example test shop zone online site store club live news cloud agency email group world xyz top pro name mobi cat jobs travel museum post aero coop blog page wiki tech digital studio design media social network systems solutions services company email academy center city guide tools works".split())
_SPACED_IP = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?:(?: dot |\.)[0-9]{1,3}){3}(?!\w)")
_SPACED_PART = re.compile(r"(?i) at | @ | dot | \. ")


_DOTTED_AFTER_AT = re.compile(r"(?i) at [A-Za-z0-9-]++\.[A-Za-z0-9]")


def _last_label(address: str) -> str:
    return re.split(r"[. _]", address.lower())[-1]


class Traced:
    """A rewritten text; ``first`` and ``past`` are the source offsets of each of its characters."""

    def __init__(self, text: str, first: np.ndarray | None = None, past: np.ndarray | None = None):
        self.text = text
        self.first = np.arange(len(text)) if first is None else first
        self.past = np.arange(1, len(text) + 1) if past is None else past

    def edited(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Ascending, disjoint (start, end, new text); a new character stands for the whole replaced stretch."""
        if not edits:
            return self
        pieces, first, past, at = [], [], [], 0
        for start, end, new in edits:
            if start < at or start == end:
                continue
            pieces += [self.text[at:start], new]
            first += [self.first[at:start], np.full(len(new), self.first[start])]
            past += [self.past[at:start], np.full(len(new), self.past[end - 1])]
            at = end
        return Traced("".join([*pieces, self.text[at:]]), np.concatenate([*first, self.first[at:]]), np.concatenate([*past, self.past[at:]]))

    def source(self, span: Span) -> Span:
        start, kind, end = span
        return int(self.first[start]), kind, int(self.past[end - 1])


def plain_characters(t: Traced) -> Traced:
    if t.text.isascii() or not _MAY_BE_ODD.search(t.text):
        return t
    return t.edited([(m.start(), m.end(), _CHARS[ord(m[0])]) for m in _ODD_CHARS.finditer(t.text)])


def undisguised(t: Traced) -> Traced:
    """At/dot disguises in brackets, then spaced ones within an address, then spelled digits."""
    low = t.text.lower()
    if any(x in low for x in ("at]", "at)", "at}", "at>", "at ]", "at )", "@]", "@)", "@}", "dot", ".]", ".)", "punto", "punkt", "point")):
        t = t.edited([(m.start(), m.end(), "@") for m in _AT.finditer(t.text)])
        t = t.edited([(m.start(), m.end(), ".") for m in _DOT.finditer(t.text)])
    if "_at_" in low:
        whole = [m for m in _UNDERSCORED.finditer(t.text) if _last_label(m[0]) in _LABELS]
        t = t.edited([(m.start() + p.start(), m.start() + p.end(), "." if "dot" in p[0].lower() else "@") for m in whole for p in _UNDERSCORED_PART.finditer(m[0])])
    if " dot " in low or " @ " in t.text or " at " in low and _DOTTED_AFTER_AT.search(t.text):
        edits = []
        for pattern in (_SPACED, _SPACED_IP):
            for m in pattern.finditer(t.text):
                # "meet at noon.then" and "look at the dot on it" are prose: their last label is none
                spaced = " . " not in m[0] or " @ " in m[0]
                if pattern is _SPACED_IP or spaced and _SPACED_PART.search(m[0]) and _last_label(m[0]) in _LABELS:
                    edits += [(m.start() + p.start(), m.start() + p.end(), "@" if "@" in p[0] or "at" in p[0].lower() else ".") for p in _SPACED_PART.finditer(m[0])]
        t = t.edited(sorted(edits))
    low = t.text.lower()
    if _SPELLED_TWO.search(low):
        edits = []
        for m in _SPELLED_RUN.finditer(t.text):
            edits.append((m.start(), m.end(), "".join(_SPELLED.get(p[0].lower(), p[0]) for p in _SPELLED_ONE.finditer(m[0])).lower().replace("plus", "+")))
        t = t.edited(edits)
    return t


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets."""
    t = undisguised(plain_characters(Traced(text)))
    if t.text is text:
        return []
    new = []
    for span in detect(t.text):
        start, kind, end = t.source(span)
        if text[start:end] != t.text[span[0] : span[2]] and not any(k == kind and s < end and start < e for s, k, e in base):
            new.append((start, kind, end))
    return new


def listed(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """A row a document: base counts by kind, the digest of base spans, all spans, and how many the method added."""

    def rows(ids: list, texts: list[str]) -> dict:
        base = [detect(x) for x in texts]
        new = [added(x, b) for x, b in zip(texts, base, strict=True)]
        counts = {f"n_{kind}": [sum(s[1] == k for s in b) for b in base] for k, kind in enumerate(KINDS)}
        return {"doc_id": ids, **counts, "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], "spans": [listed(b + n) for b, n in zip(base, new, strict=True)], "n_added": list(map(len, new))}

    return map_texts(id_text(documents), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier one shows."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kinds[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
