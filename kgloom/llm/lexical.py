"""Operator 13: ranked lexical search by inverted treaps.

An index is a table of treaps: a row for each shard of documents and term, ``doc`` ascending (the search order) and ``left``
and ``right`` such that no node has a lower ``impact`` than those below it (the heap order). A shard holds at most
``SHARD_POSTINGS`` postings (one longer document is a shard alone); its row with a null term lists its documents' ids,
ascending, whose places the treaps name. The impact of a posting is ``(SCALE * tf) div (1000 * tf + 8 * m)``, with m of the
document's length against the mean length of all documents; a term's weight of all documents multiplies it at search.

A search descends all treaps of an item together. A range of documents has a cursor a term, at the term's highest node in
that range. Their weighted impacts bound the score of every document there, so a range whose sum can't enter the item's
best k is passed over, ties by document included. Other ranges are split at the document of their heaviest
cursor, which is scored by itself; ranges of at most ``LEAF`` documents are scored whole. All items and ranges of
a shard go level by level in NumPy. Then the shards' best k meet. Nothing is lost: the bounds are exact integers.

Items come in blocks of about ``BLOCK_PAIRS`` (item, term) pairs; the index of a query set of at most ``VOCABULARY`` terms holds
their postings alone.

Nulls: a null text has no terms; a null doc_id sorts first; a null item_id is an item like others. Rows of one item_id are one item with
the terms of all. Repeated documents are ranked each, equal scores by ascending doc_id. Documents without terms
don't count in N. Items without terms, and empty tables, give no rows. Extra columns are ignored. Long texts are split whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import forget, map_texts, stored
from kgloom.llm.terms import LETTERS_AND_DIGITS, Numbers, term_pieces

SCALE = 1_000_000_000
BEST = 10
SHARD_POSTINGS = 3_000_000
#: Documents of a range that are scored at once, and cursors that go down together.
LEAF, CURSORS = 32, 1_000_000
VOCABULARY, BLOCK_PAIRS = 500_000, 100_000
_NO_ID = -(1 << 63)
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.int32()), ("ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("doc", "impact", "left", "right"))])
_INDEX_DDL = "shard long, term string, docs int, ids array<long>, doc array<int>, impact array<int>, left array<int>, right array<int>"


def lengths(texts: list[bytes]) -> list[int]:
    return [sum(map(len, term_pieces(t, LETTERS_AND_DIGITS))) for t in texts]


def corpus_size(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    own = documents.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    r = map_texts(own, lambda _, texts: {"n": lengths(texts)}, "n long").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return r[0], r[1]


def impacts(tf: np.ndarray, n: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    docs, terms = total
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        n = n.astype(object)
    m = (10 + 90 * n * docs // max(1, terms)).astype(np.int64)
    return (SCALE * tf) // (1000 * tf + 8 * m)


def treap(impact: np.ndarray, doc: np.ndarray) -> tuple[list[int], list[int], int]:
    """``left``, ``right`` and the root of postings in document order; equal impacts lie in an order of their own that keeps it shallow."""
    own = (impact << 20 | (doc * 2654435761 >> 7 & 0xFFFFF)).tolist()
    left, right, way = [-1] * len(own), [-1] * len(own), []
    for i, v in enumerate(own):
        below = -1
        while way and own[way[-1]] < v:
            below = way.pop()
        left[i] = below
        if way:
            right[way[-1]] = i
        way.append(i)
    return left, right, way[0]


class _Shard:
    """Documents of a task until they make a shard."""

    def __init__(self):
        self.ids, self.n, self.terms, self.docs, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, n: int, terms: np.ndarray) -> None:
        if len(terms):
            self.terms.append(terms)
            self.docs.append(len(self.ids))
            self.size += len(terms)
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.n.append(n)

    def rows(self, shard: int, names: list[bytes], total: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """The shard's row of ids, and its treaps in order of their terms' numbers."""
        ids, n = np.array(self.ids, np.int64), np.array(self.n, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        if self.terms:
            docs = np.repeat(place[self.docs], [len(t) for t in self.terms])
            keys, tf = np.unique(np.concatenate(self.terms) << 32 | docs, return_counts=True)
            doc, term = keys & 0xFFFFFFFF, keys >> 32
            impact = impacts(tf, n[order][doc], total)
            starts = np.flatnonzero(np.diff(term, prepend=-1))
        else:
            doc = impact = term = starts = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "term": [None], "docs": [len(ids)], "ids": [ids[order]], "doc": [[]], "impact": [[]], "left": [[]], "right": [[]]}, schema=_INDEX)
        ends = np.append(starts[1:], len(doc))
        for at in range(0, len(starts), 2000):
            some = list(zip(starts[at : at + 2000].tolist(), ends[at : at + 2000].tolist(), strict=True))
            trees = [treap(impact[a:z], doc[a:z]) for a, z in some]
            own = slice(some[0][0], some[-1][1])
            offsets = pa.array([a - own.start for a, _ in some] + [own.stop - own.start], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (doc[own], impact[own], np.concatenate([x[0] for x in trees]), np.concatenate([x[1] for x in trees]))]
            terms = pa.array([names[t] for t in term[[a for a, _ in some]]], pa.binary()).cast(pa.string())
            none = pa.array([[]] * len(some), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some)), terms, pa.array([z - a for a, z in some], pa.int32()), none, *lists], schema=_INDEX)


def indexed(documents: DataFrame, total: tuple[int, int], vocabulary: list[str] | None = None, shard_postings: int = SHARD_POSTINGS, id_col: str = "doc_id", text_col: str = "text", kept_terms: int = VOCABULARY) -> DataFrame:
    """The index of all documents, of the vocabulary's terms or of all; a task forgets the numbers of more than ``kept_terms``."""
    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast([t.encode() for t in vocabulary]) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = (shared.value, {t: i for i, t in enumerate(shared.value)}) if shared else (None, Numbers())
        shard, made = _Shard(), TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = 0, []
                for terms in term_pieces(text, LETTERS_AND_DIGITS):
                    n += len(terms)
                    own = np.fromiter(map(numbers.get, terms, repeat(-1)) if shared else map(numbers.__getitem__, terms), np.int64, len(terms))
                    found.append(own[own >= 0])
                if shard.size and shard.size + sum(map(len, found)) > shard_postings:
                    yield from shard.rows(made, names or list(numbers), total)
                    shard, made = _Shard(), made + 1
                    if not shared and len(numbers) > kept_terms:
                        old, numbers = list(numbers), Numbers()
                        found = [np.array([numbers[old[i]] for i in f.tolist()], np.int64) for f in found]
                shard.add(doc_id, n, np.concatenate(found) if found else np.zeros(0, np.int64))
        if shard.ids:
            yield from shard.rows(made, names or list(numbers), total)

    return own.mapInArrow(run, _INDEX_DDL)


class Treaps:
    """A shard's treaps of some terms, one behind the other; nodes are numbered throughout."""

    def __init__(self, ids: np.ndarray, doc: list[np.ndarray], impact: list[np.ndarray], left: list[np.ndarray], right: list[np.ndarray]):
        sizes = np.array([len(d) for d in doc], np.int64)
        self.ids, self.docs = ids, len(ids)
        first = np.cumsum(sizes) - sizes
        shift = np.repeat(first, sizes)
        self.doc, self.impact = (np.concatenate(x).astype(np.int64) for x in (doc, impact))
        self.left, self.right = (np.where(c < 0, -1, c + shift) for c in (np.concatenate(x).astype(np.int64) for x in (left, right)))
        self.key = np.repeat(np.arange(len(sizes)), sizes) * self.docs + self.doc
        under = np.zeros(len(self.doc) + 1, bool)  # a root is nobody's child
        under[self.left] = under[self.right] = True
        self.root = np.flatnonzero(~under[:-1])

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest nodes at or below ``node`` with documents from ``low`` to below ``high``; -1 for none."""
        node = node.copy()
        at = np.arange(len(node))
        while len(at):
            d = self.doc[node[at]]
            early, late = d < low[at], d >= high[at]
            off = early | late
            at, early = at[off], early[off]
            node[at] = np.where(early, self.right[node[at]], self.left[node[at]])
            at = at[node[at] >= 0]
        return node


class _Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, tuple(np.zeros(0, np.int64) for _ in range(3))
        self.score, self.doc = np.zeros(items, np.int64), np.full(items, -1)

    def open(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether such a score at such a document, or a later one, could still enter."""
        return (score > self.score[item]) | (score == self.score[item]) & (doc < self.doc[item])

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        keep = self.open(item, score, doc)
        if not keep.any():
            return
        item, score, doc = (np.concatenate([a, b[keep]]) for a, b in zip(self.held, (item, score, doc), strict=True))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        last = place == self.k - 1
        self.score[item[last]], self.doc[item[last]] = score[last], doc[last]
        self.held = item[keep], score[keep], doc[keep]


def traverse(t: Treaps, item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, k: int = BEST, leaf: int = LEAF, cursors: int = CURSORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``item, score, place`` of the best k documents of each item; a row of ``item, term, weight`` for each of its terms, by item."""
    best = _Best(items, k)
    own, of = np.unique(item, return_inverse=True)
    # ranges: their item, low and high; cursors: their range, node, term and weight, by range
    ahead = [((own, own * 0, own * 0 + t.docs), (of, t.root[term], term, weight))]
    while ahead:
        (r_item, low, high), (of, node, term, weight) = ahead.pop()
        if not len(of):
            continue
        value = weight * t.impact[node]
        starts = np.searchsorted(of, np.arange(len(r_item)))
        live = best.open(r_item, np.add.reduceat(value, starts), low)
        small = live & (high - low <= leaf)
        on = small[of]
        if on.any():
            where, width = np.cumsum(small) - 1, leaf
            base = term[on] * t.docs
            a, z = np.searchsorted(t.key, base + low[of[on]]), np.searchsorted(t.key, base + high[of[on]])
            sizes = z - a
            at = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            cell = np.repeat(where[of[on]] * width - low[of[on]], sizes) + t.doc[at]
            scores = np.zeros(small.sum() * width, np.int64)
            np.add.at(scores, cell, np.repeat(weight[on], sizes) * t.impact[at])
            hit = np.flatnonzero(scores)
            best.add(r_item[small][hit // width], scores[hit], low[small][hit // width] + hit % width)
        large = live & ~small
        on = large[of]
        if not on.any():
            continue
        where = np.cumsum(large) - 1
        r_item, low, high = r_item[large], low[large], high[large]
        of, node, term, weight, value = where[of[on]], node[on], term[on], weight[on], value[on]
        starts = np.searchsorted(of, np.arange(len(r_item)))
        top = np.flatnonzero(value == np.maximum.reduceat(value, starts)[of])
        middle = t.doc[node[top[np.searchsorted(of[top], np.arange(len(r_item)))]]]
        at = np.minimum(np.searchsorted(t.key, term * t.docs + middle[of]), len(t.key) - 1)
        hit = t.key[at] == term * t.docs + middle[of]
        best.add(r_item, np.add.reduceat(np.where(hit, weight * t.impact[at], 0), starts), middle)
        for a, z in ((middle + 1, high), (low, middle)):
            below = t.within(node, a[of], z[of])
            on = below >= 0
            some = np.unique(of[on])
            if len(some):
                part = ((r_item[some], a[some], z[some]), (np.searchsorted(some, of[on]), below[on], term[on], weight[on]))
                if ahead and len(ahead[-1][1][0]) + len(below) <= cursors:  # both halves in one step
                    (other, theirs), n = ahead.pop(), None
                    n = len(other[0])
                    part = tuple(np.concatenate(x) for x in zip(other, part[0], strict=True)), (np.concatenate([theirs[0], part[1][0] + n]), *(np.concatenate(x) for x in zip(theirs[1:], part[1][1:], strict=True)))
                ahead.append(part)
    return best.held


def searched(index: DataFrame, items: list[tuple[int | None, str]], weights: dict[str, int], k: int = BEST) -> DataFrame:
    """``item_id, doc_id, score`` of each shard's best k documents of each item; ``items`` has a row for each of its terms."""
    ids = list(dict.fromkeys(i for i, _ in items))
    number = {i: n for n, i in enumerate(ids)}
    by_term: dict[str, list[int]] = {}
    for i, t in items:
        by_term.setdefault(t, []).append(number[i])
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((ids, by_term, weights))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def found(docs: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
        ids, by_term, weights = shared.value
        rows = [r for r in rows if r[0] in by_term]
        if not rows:
            return pa.RecordBatch.from_pylist([], schema=schema)
        t = Treaps(docs, *(list(x) for x in list(zip(*rows, strict=True))[1:]))
        flat = sorted((i, n) for n, r in enumerate(rows) for i in by_term[r[0]])
        item, term = np.array(flat, np.int64).T
        weight = np.array([weights[r[0]] for r in rows], np.int64)[term]
        item, score, place = traverse(t, item, term, weight, len(ids), k)
        doc = t.ids[place]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in item.tolist()], pa.int64()), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, rows = None, None, []
        for b in batches:
            lists = [(b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy()) for c in ("ids", "doc", "impact", "left", "right")]
            for i, (shard, term) in enumerate(zip(b.column("shard").to_pylist(), b.column("term").to_pylist(), strict=True)):
                if shard != now:
                    if rows:
                        yield found(docs, rows)
                    now, docs, rows = shard, None, []
                own = [v[o[i] : o[i + 1]] for o, v in lists]
                if term is None:
                    docs = own[0].copy()
                else:
                    rows.append((term, *(x.copy() for x in own[1:])))
        if rows:
            yield found(docs, rows)

    terms = spark.createDataFrame([(t,) for t in by_term], "term string")
    own = index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.where("term is null"))
    own = own.select("shard", "term", "ids", "doc", "impact", "left", "right").repartition("shard").sortWithinPartitions("shard", "term")
    return own.mapInArrow(run, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term`` of each item, once each."""
    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def rows(_: list, texts: list[bytes]) -> dict:
        return {"terms": [list({t.decode("utf-8", "replace") for some in term_pieces(x, LETTERS_AND_DIGITS) for t in some}) for x in texts]}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows([], b.column(1).to_pylist())["terms"], pa.list_(pa.string()))], names=["item_id", "terms"])

    return own.mapInArrow(keyed, "item_id long, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct()


def ranked(documents: DataFrame, items: DataFrame, k: int = BEST, vocabulary: int = VOCABULARY, block_pairs: int = BLOCK_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's best k documents."""
    spark: SparkSession = documents.sparkSession
    asked = stored(item_terms(items), "item_terms")
    names = asked.select("term").distinct()
    wanted = [r.term for r in names.toLocalIterator()] if names.count() <= vocabulary else None
    total = corpus_size(documents)
    index = stored(indexed(documents, total, wanted, shard_postings), "treaps")
    blocks = asked.count() // block_pairs + 1
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = index.where("term is not null").select("term", "docs").join(F.broadcast(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
        weights = {r.term: math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r.df + 1))) for r in held.toLocalIterator()}
        pairs = [(r.item_id, r.term) for r in own.toLocalIterator() if r.term in weights]
        if pairs:
            parts.append(stored(searched(index, pairs, weights, k), "found"))
    forget(index, asked)
    found = parts[0] if parts else spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in parts[1:]:
        found = found.unionByName(p)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    out = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kind = dict(items.dtypes)["item_id"] if "item_id" in items.columns else "long"
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _oracle() -> str:
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with docs as (select row_number() over () as doc, doc_id, {terms} as terms from documents
), lengths as (select doc, doc_id, len(terms) as n from docs where len(terms) > 0
), sizes as (select count(*) as all_docs, sum(n) as all_terms from lengths
), asked as (select distinct item_id, unnest({terms}) as term from benchmark
), tfs as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from docs) semi join asked using (term) group by doc, term
), weights as (
  select term, cast(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs cross join sizes group by term
), impacts as (
  select doc_id, doc, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * all_docs) // all_terms))) as impact
  from tfs join lengths using (doc) cross join sizes
), scores as (
  select item_id, doc_id, doc, cast(sum(w * impact) as bigint) as score from asked join impacts using (term) join weights using (term) group by item_id, doc_id, doc
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= {BEST}
"""


ORACLE_SQL = _oracle()
