"""Operator 5: benchmark passages in documents, by SimHash windows of each item's size.

A window has as many words as the item; a text with fewer shingles than the item is its one window for it. A window can reach the similarity only if nearly all its shingles are the benchmark's, so
only such windows get a fingerprint (this loses none). The fingerprint's four blocks of 16 bits find every item
fingerprint within ``RADIUS`` bits: two that differ in no more have a block that differs in a quarter of it at most, and all such
block values are looked up; the one window of a short text meets every item that it shares a shingle with. Candidates are held against the item by weighted Jaccard similarity, a shingle weighing as
often as it occurs. Words are runs of letters, digits and underscores, in lower case; shingles have five words, or all
of a shorter item.

Benchmark items are broadcast in blocks of ``ITEM_CHARS`` characters at most, each block against all documents.

Nulls: a null text counts as empty; null or wordless items match nothing; a null item_id or doc_id is an id like others.
Repeated rows give rows each; equal items with several ids give rows for each id. Empty tables give no row. Extra columns
are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, id_text
from kgloom.llm.shingles import window_hashes, window_hashes_at

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
ITEM_CHARS = 2_000_000
#: Words of a text that are looked at together; neighbours share as many as the longest item has.
STRETCH = 200_000
_WORD = re.compile(r"\w+")
_BLOCKS = 4
SCHEMA = "doc_id long, item_id long, start long, end long, similarity double, distance int"


def lowered(text: str) -> str:
    """Lower case, character by character where that would change offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """64-bit SimHashes of ``m`` shingles from each start."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(len(shingles), 8), axis=1).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(total[starts + m] - total[starts] > 0, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """All fingerprints within a radius, by blocks of 16 bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.near = radius // _BLOCKS
        self.masks = np.array([sum(1 << b for b in c) for k in range(self.near + 1) for c in combinations(range(16), k)], np.int64)
        self.tables = []
        for b in range(_BLOCKS):
            own = (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            values, first = np.unique(own[order], return_index=True)
            self.tables.append((order, values, np.append(first, len(own))))
        self.seen: dict[int, list[tuple[int, int]]] = {}

    def within(self, fingerprint: int) -> list[tuple[int, int]]:
        """(position, distance) of every fingerprint within the radius."""
        if fingerprint not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found: set[int] = set()
            for b, (order, values, first) in enumerate(self.tables):
                own = fingerprint >> 16 * b & 0xFFFF
                if len(values) <= len(self.masks):
                    at = np.flatnonzero(np.bitwise_count(values ^ own) <= self.near)
                else:  # more values than a block can differ in: look the near ones up
                    near = own ^ self.masks
                    at = np.minimum(np.searchsorted(values, near), len(values) - 1)
                    at = at[values[at] == near]
                for k in at:
                    found.update(order[first[k] : first[k + 1]].tolist())
            at = np.array(sorted(found), np.int64)
            distance = np.bitwise_count(self.prints[at] ^ np.uint64(fingerprint))
            self.seen[fingerprint] = [(int(i), int(d)) for i, d in zip(at, distance, strict=True) if d <= self.radius]
        return self.seen[fingerprint]


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _bag(shingles: np.ndarray) -> dict[int, int]:
    values, counts = np.unique(shingles, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


class Benchmark:
    """Items by their words."""

    def __init__(self, items: list[tuple[int | None, str]], words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity = similarity
        by_words: dict[tuple[str, ...], list] = {}
        for item_id, text in items:
            if own := tuple(_WORD.findall(lowered(text))):
                by_words.setdefault(own, []).append(item_id)
        self.ids = list(by_words.values())
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for own in by_words for w in own), 1)}
        self.hash = np.concatenate([np.zeros(1, np.uint64), _hashed(list(self.words))])
        shingles = [window_hashes(_hashed(list(own)), words) for own in by_words]
        self.bags = [_bag(s) for s in shingles]
        self.longest = max((len(own) for own in by_words), default=0)
        prints = np.array([fingerprints(s, np.zeros(1, np.int64), len(s))[0] for s in shingles], np.uint64)
        #: for each shingle length and number of shingles: the index and the items in it
        self.sizes: dict[int, dict[int, tuple[HammingIndex, list[int]]]] = {}
        self.known: dict[int, np.ndarray] = {}
        #: for each shingle length: all shingles in order, and their items
        self.having: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for k, own in enumerate(by_words):
            groups.setdefault((min(words, len(own)), len(shingles[k])), []).append(k)
        for (n, m), members in groups.items():
            self.sizes.setdefault(n, {})[m] = (HammingIndex(prints[members], radius), members)
        for n, of in self.sizes.items():
            own = [k for _, members in of.values() for k in members]
            held = np.concatenate([shingles[k] for k in own])
            order = np.argsort(held, kind="stable")
            self.known[n] = np.unique(held)
            self.having[n] = held[order], np.repeat(own, [len(shingles[k]) for k in own])[order]

    def find(self, text: str) -> list[tuple]:
        """``item id, start, end, similarity, distance`` of the best window of each item; the earliest of equals."""
        words = _WORD.findall(lowered(text))
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        if not ids.any():
            return []
        best: dict[int, tuple] = {}
        for at in range(0, len(ids), STRETCH):
            self._find_some(words[at : at + STRETCH + self.longest], ids[at : at + STRETCH + self.longest], at, best)
        if not best:
            return []
        spans = [m.span() for m in _WORD.finditer(lowered(text))]
        return [(item_id, spans[s][0], spans[s + n - 1][1], sim, d) for k, (sim, s, n, d) in sorted(best.items()) for item_id in self.ids[k]]

    def _find_some(self, words: list[str], ids: np.ndarray, offset: int, best: dict[int, tuple]) -> None:
        hashes = None
        for n, of in self.sizes.items():
            if len(ids) < n:
                continue
            zero = np.concatenate([[0], np.cumsum(ids == 0)])
            whole = np.flatnonzero(zero[n:] == zero[:-n])  # windows of benchmark words alone
            if not len(whole):
                continue
            own = window_hashes_at(self.hash[ids], whole, n)
            found = self.known[n][np.minimum(np.searchsorted(self.known[n], own), len(self.known[n]) - 1)] == own
            if not found.any():
                continue
            quick = np.zeros(len(ids) - n + 1, bool)
            quick[whole[found]] = True
            hits = np.concatenate([[0], np.cumsum(quick)])
            shingles = None
            for m, (index, members) in of.items():
                size = min(m, len(quick))  # a text with fewer shingles is one window
                if size < m and (offset or size < self.similarity * m - 1e-9):
                    continue
                # similarity s needs s/(1+s) of both sides' shingles in common
                needed = self.similarity / (1 + self.similarity) * (m + size) - 1e-9
                starts = np.flatnonzero(hits[size:] - hits[:-size] >= needed)
                if not len(starts):
                    continue
                if shingles is None:
                    if hashes is None:
                        hashes = _hashed(words)
                    shingles = window_hashes(hashes, n)
                for lo in range(0, len(starts), 4096):
                    part = starts[lo : lo + 4096]
                    a, b = part[0], part[-1] + size
                    for s, fp in zip(part.tolist(), fingerprints(shingles[a:b], part - a, size).tolist(), strict=True):
                        for place, distance in index.within(fp) if size == m else self._sharing(n, members, index.prints, shingles, fp):
                            k = members[place]
                            bag, mine = self.bags[k], _bag(shingles[s : s + size])
                            common = sum(min(c, bag.get(h, 0)) for h, c in mine.items())
                            sim = common / (m + size - common)
                            if sim >= self.similarity - 1e-12 and (k not in best or (-sim, s + offset) < (-best[k][0], best[k][1])):
                                best[k] = (sim, s + offset, size + n - 1, distance)

    def _sharing(self, n: int, members: list[int], prints: np.ndarray, shingles: np.ndarray, fingerprint: int) -> list[tuple[int, int]]:
        """(position, distance) of the members with a shingle of a short text, at any distance."""
        held, items = self.having[n]
        own = np.unique(shingles)
        ranges = zip(np.searchsorted(held, own, "left").tolist(), np.searchsorted(held, own, "right").tolist(), strict=True)
        places = np.flatnonzero(np.isin(members, np.unique(np.concatenate([items[a:b] for a, b in ranges]))))
        return [(int(p), int(d)) for p, d in zip(places, np.bitwise_count(prints[places] ^ np.uint64(fingerprint)), strict=True)]


def blocks(benchmark: DataFrame, chars: int = ITEM_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in parts of about ``chars`` characters at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, r.text) for r in own.collect()]  # about ``chars`` characters


def contaminated(documents: DataFrame, benchmark: DataFrame, chars: int = ITEM_CHARS, **how) -> DataFrame:
    """A row for each document and item found in it; the items are broadcast ``chars`` characters at a time, each part against all documents."""
    spark, docs = documents.sparkSession, id_text(documents)
    arrow = arrow_schema(SCHEMA)
    found = spark.createDataFrame([], SCHEMA)
    for k, items in enumerate(blocks(benchmark, chars)):
        shared = spark.sparkContext.broadcast(Benchmark(items, **how))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *hit) for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for hit in shared.value.find(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

        part = docs.mapInArrow(run, SCHEMA)
        found = found.union(part) if k else part
    return found


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", chars: int = ITEM_CHARS, **how) -> DataFrame:
    """The rows whose text holds no benchmark item, as they are."""
    for items in blocks(benchmark, chars):
        documents = documents.where(_clean(documents.sparkSession.sparkContext.broadcast(Benchmark(items, **how)))(F.col(text_col)))
    return documents


def _clean(shared: Broadcast):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([x is None or not shared.value.find(x) for x in texts], dtype=bool)

    return clean
