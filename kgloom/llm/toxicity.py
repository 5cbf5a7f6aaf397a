"""Operator 9: toxicity by a subsequence-kernel support vector machine on Nyström landmarks.

The kernel counts common subsequences of three characters, each weighted by ``DECAY`` to the length it spans, up to
``SPAN``; so a letter put in or left out lowers an insult's likeness but doesn't hide it. Landmarks are strings taken from
labelled texts: those inside words that set toxic texts apart, and stems, with which several of a toxic text's words begin (" stem";
the white space before a word is its first character). A text's feature for a landmark is the largest kernel value of any of its
words with the landmark, relative to the landmark's own; for a stem the second largest over longer words, since in a clean text one
word may be or begin so by chance. Features are whitened by the landmarks'
kernel matrix (Nyström), a squared-hinge support vector machine is fitted to the labels, and a sigmoid calibrates it.
Letters are folded (case; digits and marks used as letters); words spelled out letter by letter are closed up; words of over ``LONGEST``
characters count in stretches of that many, and again in stretches that begin half as far on, so that a landmark and what is put into it
stand whole in one of them wherever they are.

Only fitting uses a sample: at most ``SAMPLE`` labelled documents a class, in the order of a hash of their id; of the toxic ones at most
``SENTENCES`` sentences. Every whole text is scored.

Nulls: a null text counts as empty, and empty texts get the score of no insult; null labels are not learnt from. A null
doc_id is not held out. Repeated rows give a row each. Without two classes of labels every score is 0. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, id_text

SAMPLE = 1500
SENTENCES = 20_000
LANDMARKS = 96
DECAY = 0.75
SPAN = 6
FLOOR = 0.6
POWER = 2
#: What clean texts may weigh against toxic ones when fitting; ``FOLDS`` folds of the training texts decide.
CLEAN_WEIGHTS, FOLDS = (1.0, 2.0, 3.0), 3
LONGEST = 40
THRESHOLD = 0.7
#: No letter has this code point or a higher one.
_PAST_LETTERS = 0x40000
#: White space, as the character that begins a word.
_SPACE = 1
_AT_ONCE = 400_000

# Marks and digits used in place of letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _code_table() -> np.ndarray:
    """The folded letter's code point for letters of any script, 0 for what never matches, 1 for white space."""
    table = np.zeros(_PAST_LETTERS, np.int32)
    for c in range(_PAST_LETTERS):
        own = chr(c).lower()
        own = _LEET.get(own, own)
        if own.isspace():
            table[c] = _SPACE
        elif own.isalpha() and len(own) == 1:
            table[c] = ord(own)
    return table


_CODES = _code_table()
_PAIRS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_SENTENCE = r"(?<=[.!?\n])\s+"


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < _PAST_LETTERS, _CODES[np.minimum(points, _PAST_LETTERS - 1)], 0)


def closed_up(text: str) -> str:
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text)


class Landmarks:
    """Strings and their weighted subsequences, looked up by triples of the letters that the strings have."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.stem = np.array([s.startswith(" ") for s in strings], bool)
        self.length = np.array([(codes(s) > 0).sum() for s in strings])
        letters = sorted({int(x) for s in strings for x in codes(s) if x > 0})
        self.size = r = len(letters) + 1
        self.letter = np.zeros(_PAST_LETTERS, np.int32)
        self.letter[letters] = np.arange(1, r)
        features = []
        for s in strings:
            c, own = self.letter[codes(s)], Counter()
            for i, j in _PAIRS:
                for k in range(len(c) - j):
                    if c[k] and c[k + i] and c[k + j]:
                        own[(int(c[k]) * r + int(c[k + i])) * r + int(c[k + j])] += DECAY ** (j + 1)
            features.append(own)
        m = len(strings)
        self.own = np.array([sum(v * v for v in f.values()) for f in features])
        if not all(self.own):
            raise ValueError("a landmark has three letters at least")
        kernel = np.array([[sum(v * b.get(u, 0.0) for u, v in a.items()) for b in features] for a in features]).reshape(m, m)
        scale = np.sqrt(np.maximum(self.own, 1e-12))
        values, vectors = np.linalg.eigh(kernel / scale[:, None] / scale + 1e-3 * np.eye(m)) if m else (np.zeros(0), np.zeros((0, 0)))
        self.whiten = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        rows = sorted((u, k, v) for k, f in enumerate(features) for u, v in f.items())
        self.of = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows])
        u = np.array([r[0] for r in rows], np.int64)
        self.triples, first = np.unique(u, return_index=True)
        self.at = np.append(first, len(u))
        self.starts = np.zeros(r * r, bool)
        self.starts[self.triples // r] = True

    def of_words(self, c: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
        """Kernel values, words by landmarks, of the characters ``c`` that belong to ``word``."""
        m = len(self.strings)
        c = self.letter[c].astype(np.int64)
        keys, values = [], []
        for i, j in _PAIRS:
            n = len(c) - j
            if n <= 0:
                continue
            two = c[:n] * self.size + c[i : i + n]
            hit = np.flatnonzero(self.starts[two] & (word[:n] == word[j : j + n]))
            u = two[hit] * self.size + c[j : j + n][hit]
            place = np.minimum(np.searchsorted(self.triples, u), len(self.triples) - 1)
            known = self.triples[place] == u
            hit, place = hit[known], place[known]
            first = self.at[place]
            count = self.at[place + 1] - first
            ends = np.cumsum(count)
            entry = np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
            keys.append(np.repeat(word[hit], count) * m + self.of[entry])
            values.append(self.weight[entry] * DECAY ** (j + 1))
        if not keys:
            return np.zeros((n_words, m))
        return np.bincount(np.concatenate(keys), np.concatenate(values), n_words * m).reshape(n_words, m)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Features, texts by landmarks: each the strongest word's (a stem's: the second), cut at ``FLOOR``, 0 to 1."""
        out, at = np.zeros((len(texts), len(self.strings))), 0
        if not self.strings:
            return out
        while at < len(texts):
            past, size = at, 0
            while past < len(texts) and (past == at or size + len(texts[past]) <= _AT_ONCE):
                size += len(texts[past]) + 1
                past += 1
            self._of_some(texts[at:past], out[at:past])
            at = past
        return out

    def _of_some(self, texts: list[str], out: np.ndarray) -> None:
        own = [codes(" " + closed_up(x)) for x in texts]
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        c = np.concatenate(own)
        begins = c == _SPACE
        start = np.maximum.accumulate(np.where(begins, np.arange(len(c)), 0))
        along = np.arange(len(c)) - start
        far = np.bincount(np.cumsum(begins) - 1)[np.cumsum(begins) - 1] > LONGEST
        begins |= along % LONGEST == 0
        word = np.cumsum(begins) - 1
        word_of = of[begins]
        stem, ends = self.stem, np.cumsum(np.bincount(word, c > 0))
        second = np.zeros((len(out), stem.sum()))
        for lo in range(0, len(word_of), 100_000):  # a long text's words, some at a time
            a, b = np.searchsorted(word, [lo, lo + 100_000])
            n = min(100_000, len(word_of) - lo)
            x = self._relative(c[a:b], word[a:b] - lo, n)
            letters = np.diff(ends[lo : lo + n], prepend=ends[lo - 1] if lo else 0)
            x[:, stem] *= letters[:, None] > self.length[stem]  # a stem isn't a word itself
            mine = word_of[lo : lo + n]
            cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            rows, top = mine[cuts], np.maximum.reduceat(x, cuts, axis=0)
            if stem.any():
                y, most = x[:, stem], top[:, stem]
                tops = y == np.repeat(most, np.diff(np.append(cuts, n)), axis=0)
                two = np.where(np.add.reduceat(tops, cuts, axis=0, dtype=np.int64) > 1, most, np.maximum.reduceat(np.where(tops, 0.0, y), cuts, axis=0))
                second[rows] = np.maximum(np.maximum(second[rows], two), np.minimum(out[rows][:, stem], most))
            out[rows] = np.maximum(out[rows], top)
        out[:, stem] = second
        # long words once more, from half a stretch on; a stem begins a word and isn't met there
        again = far & (along >= LONGEST // 2)
        c, of, begins = c[again], of[again], (along[again] - LONGEST // 2) % LONGEST == 0
        word, word_of = np.cumsum(begins) - 1, of[begins]
        for lo in range(0, len(word_of), 100_000):
            a, b = np.searchsorted(word, [lo, lo + 100_000])
            n = min(100_000, len(word_of) - lo)
            x = self._relative(c[a:b], word[a:b] - lo, n)
            x[:, stem] = 0
            np.maximum.at(out, word_of[lo : lo + n], x)

    def _relative(self, c: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        x = self.of_words(c, word, n) / self.own
        return (np.maximum(np.minimum(x, 1.0) - FLOOR, 0.0) / (1 - FLOOR)) ** POWER


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scores_of(self.landmarks.of_texts(texts))

    def scores_of(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(features))
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def choose_stems(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Starts of 3 to 10 letters that two longer words of a toxic text share, each taken for the texts that it adds."""

    def shared(own: Iterator[str]) -> set[str]:
        n = Counter(w[:k] for w in own for k in range(3, min(11, len(w))))
        return {s for s, c in n.items() if c > 1}

    bad, good = (Counter(s for x in part for s in shared(iter(x))) for part in (toxic, clean))
    ratio = max(1, len(clean)) / max(1, len(toxic))
    least = _least(toxic, clean, len(bad))
    held = [s for s, n in bad.items() if n >= least and n * ratio > 8 * good[s]]
    held.sort(key=lambda s: (-bad[s] * (1 + 0.1 * len(s)), s))
    chosen: list[str] = []
    for s in held:
        # texts in which two words begin so that no stem before explains
        if sum(sum(len(w) > len(s) and w.startswith(s) and not w.startswith(tuple(chosen)) for w in x) > 1 for x in toxic) >= least:
            chosen.append(s)
            if len(chosen) == most:
                break
    return chosen


def _least(toxic: list, clean: list, tried: int) -> int:
    """So many toxic texts that, of as many strings, none would be in toxic texts alone by chance."""
    share = len(toxic) / (len(toxic) + len(clean))
    return max(4, len(toxic) // 100, math.ceil(math.log(20 * max(1, tried)) / -math.log(share)))


def choose_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> list[str]:
    """Stems, and strings of 4 to 10 letters inside other words of toxic texts, each taken for the toxic texts that it adds."""
    split = re.compile(r"[^\W\d_]+")
    words = [[set(split.findall(closed_up(x).lower())) for x in part] for part in (toxic, clean)]
    stems = choose_stems(*words, most // 2)
    words[0] = [{w for w in x if not w.startswith(tuple(stems))} for x in words[0]]
    bad, good = (Counter(w for x in part for w in x) for part in words)
    ratio = max(1, len(clean)) / max(1, len(toxic))
    # words that set toxic texts apart; what one text alone has says nothing
    marked = {w: n for w, n in bad.items() if len(w) >= 4 and n > 1 and n * ratio > 8 * good[w]}
    inside: Counter = Counter()
    where: dict[str, set[str]] = {}
    for w, n in marked.items():
        for s in {w[i : i + k] for k in range(4, 11) for i in range(len(w) - k + 1)}:
            inside[s] += n
            where.setdefault(s, set()).add(w)
    least = _least(toxic, clean, len(inside))
    inside = Counter({s: n for s, n in inside.items() if n >= least})
    where = {s: where[s] for s in inside}
    against: Counter = Counter()
    for w, n in good.items():
        for s in {w[i : i + k] for k in range(4, 11) for i in range(len(w) - k + 1)} & inside.keys():
            against[s] += n
    texts_of: dict[str, set[int]] = {}
    for k, x in enumerate(words[0]):
        for w in x & marked.keys():
            texts_of.setdefault(w, set()).add(k)
    held = []
    for s, n in inside.items():
        if n >= least and n * ratio > 8 * against[s] and (codes(s) > 0).sum() >= 3:
            own = set().union(*(texts_of[w] for w in where[s]))
            if len(own) >= least and len(own) * ratio > 8 * against[s]:
                held.append((s, len(own)))
    held.sort(key=lambda x: (-x[1] * (1 + 0.1 * len(x[0])), x[0]))  # whole words before their parts
    chosen: list[str] = []
    explained: set[str] = set()
    covered: Counter = Counter()
    for s, _ in held:
        # what this string adds: texts that few strings mark so far, by words that no string before explains
        own = set().union(*(texts_of[w] for w in where[s] - explained))
        if sum(covered[k] < 4 for k in own) >= least:
            chosen.append(s)
            explained |= where[s]
            covered.update(own)
            if len(stems) + len(chosen) == most:
                break
    return [*(" " + s for s in stems), *chosen]


def fit_svm(x: np.ndarray, y: np.ndarray, clean_weight: float, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear squared-hinge machine by Newton steps over its support vectors."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 1 / (y > 0).sum(), clean_weight / (y <= 0).sum())
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(60):
        on = y * (z @ w) < 1
        zs = z[on] * weight[on, None]
        new = np.linalg.solve(penalty + zs.T @ z[on], zs.T @ y[on])
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def fit_sigmoid(f: np.ndarray, y: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Platt's calibration."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 1 / n1, clean_weight / n0)
    z = np.stack([f, np.ones_like(f)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - target)) + 1e-4 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def fit(toxic: list[str], clean: list[str]) -> Model:
    """A model of labelled texts. The weight of clean ones is that with the best mean of found toxic and kept clean texts over ``FOLDS``
    folds, each judged by models of the others; the smaller of equal ones."""
    if min(len(toxic), len(clean)) < FOLDS:
        return fit_all(toxic, clean, CLEAN_WEIGHTS[:1])[0]
    right = np.zeros(len(CLEAN_WEIGHTS))
    for fold in range(FOLDS):
        models = fit_all(*([t for i, t in enumerate(part) if i % FOLDS != fold] for part in (toxic, clean)))
        for part, is_toxic in ((toxic[fold::FOLDS], True), (clean[fold::FOLDS], False)):
            x = models[0].landmarks.of_texts(part)
            right += [((m.scores_of(x) >= THRESHOLD) == is_toxic).mean() for m in models]
    return fit_all(toxic, clean, [CLEAN_WEIGHTS[int(np.argmax(right.round(9)))]])[0]


def fit_all(toxic: list[str], clean: list[str], clean_weights: Sequence[float] = CLEAN_WEIGHTS) -> list[Model]:
    """A model for each weight of clean texts, all of the same landmarks."""
    none = [Model(Landmarks([]), np.zeros(0), 0.0, 1.0, 0.0)] * len(clean_weights)
    if not toxic or not clean:
        return none
    marks = Landmarks(choose_landmarks(toxic, clean))
    # a toxic text and its sentences are toxic where they hold a landmark (or a stem twice), others say nothing; a clean text's
    # features are the largest of all its sentences
    texts, own = (x[x.max(axis=1, initial=0) >= 0.9] for x in map(marks.of_texts, (toxic, [p for x in toxic for p in re.split(_SENTENCE, x) if p][:SENTENCES])))
    own = np.vstack([own, np.repeat(texts, max(1, len(own) // max(1, len(texts))), axis=0)])  # texts weigh as much as sentences
    # landmarks but stems with one mark put in, as often together as half those rows
    disguised = marks.of_texts([s[:k] + "." + s[k:] for s in marks.strings if s[0] != " " for k in range(1, len(s))])
    disguised = np.repeat(disguised, max(1, len(own) // (2 * max(1, len(disguised)))), axis=0)
    x = np.vstack([own, disguised, marks.of_texts(clean)])
    y = np.where(np.arange(len(x)) < len(own) + len(disguised), 1.0, -1.0)
    if not len(own):
        return none
    models, white = [], x @ marks.whiten
    for clean_weight in clean_weights:
        w, bias = fit_svm(white, y, clean_weight)
        weights = marks.whiten @ w
        models.append(Model(marks, weights, bias, *fit_sigmoid(x @ weights + bias, y, clean_weight)))
    return models


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents a class that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (1, 0)]
    ids = picked[0].union(picked[1])  # at most two samples
    rows = id_text(documents).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    texts: dict[int, dict[str, None]] = {0: {}, 1: {}}
    for r in rows.select("toxic", "text").collect():
        texts[int(r.toxic)].setdefault(r.text)
    return fit(list(texts[1]), list(texts[0]))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    arrow = arrow_schema("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], schema=arrow)

    found = id_text(documents).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(["" if x is None else x for x in texts]))

    return documents.where(score(F.col(text_col)) < THRESHOLD)
