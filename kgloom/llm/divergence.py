"""Operator 12: how far the sources of a language differ in their words, by a heavy-light split of its terms.

Each language keeps the V terms of at least ``LEAST_DOCS`` of its documents. A group is a (lang, source); with ``count``
occurrences there, N of all kept terms, a term has ``p = 1 + (SCALE * (count + 2)) div (N + 2 * V)``. The divergence of two
groups is the sum over all kept terms of ``f(p, q) = (p - q)**2 div (p + q)``, all in integers.

A pair's sum is taken apart so that no term is paired with groups that lack it:

* heavy terms, those of at least one in ``HEAVY`` of the language's groups: tiles of groups x terms as int64 arrays, each pair
  of rows summed;
* light terms: as though neither group had them, every term adds ``f(b_g, b_h)`` of the two groups' p at count 0. A posting of g
  moves that to ``f(p, b_h)``; only how often each p occurs among g's postings counts, so these are counted first. Where
  both groups have the term, the pair within its posting list puts ``f(p, q)`` in place of both moves.

Both partial sums are exact; a task sends a row of sums for each group, and equal groups' rows are added. A task sums slabs of at most ``SLAB_CELLS`` pairs. The groups
(not their terms) go to the driver and to each task: the result has a row for each pair of a language's, so they are far fewer than
its rows.

Nulls: a null text, lang or source is ''. Every group that occurs has its rows, also without terms: p is then that of count
0; without kept terms all values are 0 and no term is listed. Long texts are cut at term borders and their documents counted once.
Repeated rows count each; ties are ordered by item. Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import forget, stored
from kgloom.llm.terms import LETTERS, Numbers, summed, term_pieces

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: A term is heavy if ``HEAVY`` times its groups are at least the language's groups.
HEAVY = 4
#: Entries and terms that a task counts before it sends them on, and terms looked up at once.
HELD, AT_ONCE = 1_500_000, 2_000_000
#: Pairs of groups that a task sums, cells of a tile.
SLAB_CELLS, TILE = 1 << 22, 1 << 18


class _Counts:
    """Occurrences and documents of (group, term) in a task. Keys are ``group << 32 | term``."""

    def __init__(self):
        self.numbers, self.parts, self.size = Numbers(), [], 0
        self.terms, self.groups, self.docs, self.met, self.doc = [], [], [], 0, 0

    def add(self, text: bytes, group: int) -> None:
        self.doc += 1
        for terms in term_pieces(text, LETTERS):
            if terms:
                self.terms.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
                self.groups.append(group)
                self.docs.append(self.doc)
                self.met += len(terms)

    def count(self) -> None:
        """Count what ``add`` met; all pieces of a text are there."""
        if self.terms:
            sizes = [len(x) for x in self.terms]
            terms, groups, docs = np.concatenate(self.terms), np.repeat(self.groups, sizes), np.repeat(self.docs, sizes)
            own = np.sort(groups << 32 | terms)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            # a document's group goes with it: its distinct terms, then the documents of each
            once = np.sort((docs - docs[0]) << 32 | terms)
            once = once[np.diff(once, prepend=-1) != 0]
            group_of = np.zeros(docs[-1] - docs[0] + 1, np.int64)
            group_of[np.array(self.docs) - docs[0]] = self.groups
            held = np.sort(group_of[once >> 32] << 32 | once & 0xFFFFFFFF)
            self.parts.append((own[starts], np.diff(starts, append=len(own)), np.diff(np.flatnonzero(np.diff(held, prepend=-1)), append=len(held))))
            self.size += len(starts)
        self.terms, self.groups, self.docs, self.met = [], [], [], 0
        if self.size > HELD and len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > HELD or len(self.numbers) > HELD


def term_lists(documents: DataFrame, groups: list[tuple[str, str]], least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, term, g, n`` of each language's kept terms: the numbers of the groups that have it, and how often."""
    place, langs = {g: i for i, g in enumerate(groups)}, sorted({lang for lang, _ in groups})
    lang_at = {lang: i for i, lang in enumerate(langs)}
    lang_of = np.array([lang_at[lang] for lang, _ in groups], np.int64)
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("g", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    ddl = "lang string, term string, docs long, g array<int>, n array<long>"

    def lists(row: np.ndarray, g: np.ndarray, n: np.ndarray, lang: pa.Array, term: pa.Array, docs: np.ndarray) -> pa.RecordBatch:
        """Entries of ascending ``row`` as one list a row."""
        ends = pa.array(np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]]), pa.int32())
        return pa.RecordBatch.from_arrays([lang, term, pa.array(docs), pa.ListArray.from_arrays(ends, pa.array(g, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))], schema=schema)

    def sent(counts: _Counts) -> Iterator[pa.RecordBatch]:
        if counts.parts:
            keys, n, docs = summed(*(np.concatenate(x) for x in zip(*counts.parts, strict=True)))
            term, g = keys & 0xFFFFFFFF, keys >> 32
            order = np.lexsort((g, term, lang_of[g]))
            term, g, n, docs = term[order], g[order], n[order], docs[order]
            row = lang_of[g] << 32 | term
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            names = pa.array(list(counts.numbers), pa.binary())
            yield lists(row, g, n, pa.array(langs, pa.string()).take(pa.array(lang_of[g[starts]])), names.take(pa.array(term[starts])).cast(pa.string()), np.add.reduceat(docs, starts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts.add(text, place[lang, source])
                if counts.met >= AT_ONCE:
                    counts.count()
                    if counts.full():
                        yield from sent(counts)
                        counts = _Counts()
        counts.count()
        yield from sent(counts)

    def merged(held: pa.Table) -> pa.RecordBatch:
        lang, term = held["lang"].combine_chunks(), held["term"].combine_chunks()
        new = np.ones(len(term), bool)
        if len(term) > 1:
            new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
        starts, key = np.flatnonzero(new), np.cumsum(new) - 1
        docs = np.add.reduceat(held["docs"].to_numpy(), starts)
        sizes = pc.list_value_length(held["g"]).to_numpy()
        g, n = (pc.list_flatten(held[c]).to_numpy() for c in ("g", "n"))
        keys, n = summed(np.repeat(key, sizes) << 32 | g, n)
        keep = docs >= least_docs
        own = keep[keys >> 32]
        at = pa.array(starts[keep])
        return lists(keys[own] >> 32, keys[own] & 0xFFFFFFFF, n[own], lang.take(at), term.take(at), docs[keep])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a term follow each other; a batch's last term waits for the next batch."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t.num_rows:
                last = t["lang"][-1], t["term"][-1]
                same = pc.and_(pc.equal(t["lang"], last[0]), pc.equal(t["term"], last[1])).to_numpy()
                cut = t.num_rows - int(same.sum())
                rest = t.slice(cut)
                if cut:
                    yield merged(t.slice(0, cut))
                if rest.num_rows > 1:  # so that what waits is one row, however often a term comes
                    rest = _one_row(rest)
        if rest is not None and rest.num_rows:
            yield merged(rest)

    def _one_row(t: pa.Table) -> pa.Table:
        g, n = summed(pc.list_flatten(t["g"]).to_numpy().astype(np.int64), pc.list_flatten(t["n"]).to_numpy())
        return pa.Table.from_batches([lists(g * 0, g, n, t["lang"].combine_chunks()[:1], t["term"].combine_chunks()[:1], np.array([pc.sum(t["docs"]).as_py()]))])

    own = documents.select(*(F.coalesce(F.col(c), F.lit("")).cast(t).alias(a) for c, t, a in ((text_col, "binary", "text"), (lang_col, "string", "lang"), (source_col, "string", "source"))))
    return own.mapInArrow(count, ddl).repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, ddl).drop("docs")


def probability(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """``1 + SCALE * (n + 2) div (total + 2 * v)``, exact where that product leaves 64 bits too."""
    if len(n) and n.max() > (1 << 63) // SCALE - 3:
        n = n.astype(object)
    return (1 + SCALE * (n + 2) // (total + 2 * v)).astype(np.int64)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Pairs:
    """Partial sums over some terms of the pairs of one language's groups ``first`` to ``last`` with all its groups."""

    def __init__(self, base: np.ndarray, first: int, last: int):
        self.base, self.first, self.last = base, first, last
        self.sums = np.zeros((last - first, len(base)), np.int64)
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best: tuple | None = None

    def add(self, sizes: np.ndarray, groups: np.ndarray, p: np.ndarray, heavy: int) -> None:
        """Posting lists of ``sizes``, one behind the other."""
        dense = sizes * heavy >= len(self.base)
        starts = np.cumsum(sizes) - sizes
        at, width = np.flatnonzero(dense), max(1, TILE // len(self.base))
        for i in range(0, len(at), width):
            self._tile(starts[at[i : i + width]], sizes[at[i : i + width]], groups, p)
        for size in np.unique(sizes[~dense]):
            of = starts[~dense & (sizes == size)][:, None] + np.arange(size)
            self._postings(groups[of], p[of])

    def _tile(self, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, p: np.ndarray) -> None:
        term = np.repeat(np.arange(len(starts)), sizes)
        of = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(term))
        tile = np.repeat(self.base[:, None], len(starts), axis=1)
        tile[groups[of], term] = p[of]
        for g in range(self.first, self.last):
            self.sums[g - self.first] += _f(tile[g], tile).sum(axis=1)

    def _postings(self, groups: np.ndarray, p: np.ndarray) -> None:
        """Lists of one size, a row each."""
        self.sums += len(groups) * _f(self.base[self.first : self.last, None], self.base)
        inside = (groups >= self.first) & (groups < self.last)
        keys, at = np.unique(np.concatenate([self.keys, (groups << 31 | p)[inside]]), return_inverse=True)
        self.times = np.bincount(at, np.concatenate([self.times, np.ones(int(inside.sum()))]), len(keys)).astype(np.int64)
        self.keys = keys
        for i in range(groups.shape[1]):
            own = inside[:, i]
            for j in range(groups.shape[1]):
                if i != j and own.any():
                    g, h, pg, ph = groups[own, i], groups[own, j], p[own, i], p[own, j]
                    bg, bh = self.base[g], self.base[h]
                    np.add.at(self.sums, (g - self.first, h), _f(pg, ph) - _f(pg, bh) - _f(bg, ph) + _f(bg, bh))

    def keep(self, groups: np.ndarray, value: np.ndarray, term: pa.Array, top: int) -> None:
        """Terms by group: those among a group's ``top`` so far stay, all equal ones too."""
        if self.best:
            groups, value, term = np.concatenate([self.best[0], groups]), np.concatenate([self.best[1], value]), pa.concat_arrays([self.best[2], term])
        order = np.lexsort((-value, groups))
        groups, value = groups[order], value[order]
        least = value[np.minimum(np.searchsorted(groups, groups) + top, np.searchsorted(groups, groups, "right")) - 1]
        stay = value >= least
        self.best = groups[stay], value[stay], term.take(pa.array(order[stay]))


class _Lang:
    """A language's groups: the number of its first, their occurrences of kept terms, and its kept terms."""

    def __init__(self, first: int, totals: list[int], v: int):
        self.first, self.totals, self.v = first, np.array(totals, np.int64), v
        self.base = probability(self.totals * 0, self.totals, v)


_PART = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("sums", pa.list_(pa.int64())), ("p", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("above", pa.list_(pa.int64()))])


def _lists(groups: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    """``values`` of ascending ``groups`` as a list for each of ``count`` groups."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(count + 1)), pa.int32()), values)


def compared(postings: DataFrame, langs: dict[str, _Lang], top: int = TOP, heavy: int = HEAVY, slab_cells: int = SLAB_CELLS) -> DataFrame:
    """Each task's part, a row a group: ``sums`` with each of the language's groups, how often each ``p`` occurs among its light
    postings, and its best terms, ``above`` the language."""
    shared = postings.sparkSession.sparkContext.broadcast(langs)

    def sent(lang: str, pairs: _Pairs) -> pa.RecordBatch:
        count, first = pairs.last - pairs.first, pairs.first
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()))
        groups, value, term = pairs.best or none
        sums = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * len(pairs.base), pa.int32()), pa.array(pairs.sums.ravel()))
        light = pairs.keys >> 31
        lists = (_lists(light - first, count, pa.array(pairs.keys & (1 << 31) - 1)), _lists(light - first, count, pa.array(pairs.times)), _lists(groups - first, count, term), _lists(groups - first, count, pa.array(value)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * count, pa.string()), pa.array(np.arange(first, pairs.last), pa.int32()), sums, *lists], schema=_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, None
        for b in batches:
            keys = list(zip(b.column("lang").to_pylist(), b.column("first").to_pylist(), strict=True))
            flat_g, flat_n = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("g", "n"))
            ends = np.concatenate([[0], np.diff(b.column("g").offsets.to_numpy()).cumsum()])
            changes = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(changes, changes[1:], strict=False):
                if a == z:
                    continue
                lang, first = keys[a]
                own = shared.value[lang]
                if keys[a] != now:
                    if pairs:
                        yield sent(now[0], pairs)
                    now = keys[a]
                    pairs = _Pairs(own.base, first, min(len(own.base), first + max(1, slab_cells // len(own.base))))
                sizes, groups, n = np.diff(ends[a : z + 1]), flat_g[ends[a] : ends[z]] - own.first, flat_n[ends[a] : ends[z]]
                p = probability(n, own.totals[groups], own.v)
                pairs.add(sizes, groups, p, heavy)
                q = np.repeat(probability(np.add.reduceat(n, np.cumsum(sizes) - sizes), own.totals.sum(), own.v), sizes)
                above = np.flatnonzero((p > q) & (groups >= pairs.first) & (groups < pairs.last))
                term = b.column("term").slice(a, z - a).take(pa.array(np.repeat(np.arange(z - a), sizes)[above]))
                pairs.keep(groups[above], _f(p[above], q[above]), term, top)
        if pairs:
            yield sent(now[0], pairs)

    steps = {lang: max(1, slab_cells // len(own.base)) for lang, own in langs.items()}
    if all(len(own.base) <= steps[lang] for lang, own in langs.items()):
        slabs = postings.withColumn("first", F.lit(0))
    else:  # all pairs of a language are too many for one task: a slab of its groups at a time
        firsts = [(lang, list(range(0, len(own.base), steps[lang]))) for lang, own in langs.items()]
        slabs = postings.join(F.broadcast(postings.sparkSession.createDataFrame(firsts, "lang string, firsts array<int>")), "lang")
        slabs = slabs.withColumn("first", F.explode("firsts")).repartition("lang", "first", "term").sortWithinPartitions("lang", "first")
    return slabs.select("lang", "first", "term", "g", "n").mapInArrow(run, "lang string, g int, sums array<long>, p array<long>, times array<long>, terms array<string>, above array<long>")


def met(parts: DataFrame, langs: dict[str, _Lang], top: int = TOP) -> DataFrame:
    """``lang, g, h, value, term, rank`` from ``compared`` parts: addends of pairs, and each group's best terms (``h`` null)."""
    shared = parts.sparkSession.sparkContext.broadcast(langs)
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64()), ("term", pa.string()), ("rank", pa.int32())])

    def whole(lang: str, g: int, sums: np.ndarray, p: np.ndarray, times: np.ndarray, best: list[tuple[int, bytes]]) -> pa.RecordBatch:
        base = shared.value[lang].base
        moved = np.zeros(len(base), np.int64)
        p, times = summed(p, times)
        for at in range(0, len(p), max(1, TILE // len(base))):
            own = slice(at, at + max(1, TILE // len(base)))
            moved += (times[own, None] * (_f(p[own, None], base) - _f(base[g], base))).sum(axis=0)
        other, same = np.delete(np.arange(len(base)), g), [g] * (len(base) - 1)
        terms = sorted(best)[:top]
        none = [None] * 2 * len(same)
        return pa.RecordBatch.from_pydict({"lang": [lang] * (len(none) + len(terms)), "g": [*same, *other.tolist(), *[g] * len(terms)], "h": [*other.tolist(), *same, *[None] * len(terms)], "value": [*(sums + moved)[other].tolist(), *moved[other].tolist(), *(-v for v, _ in terms)], "term": [*none, *(t.decode() for _, t in terms)], "rank": [*none, *range(1, len(terms) + 1)]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("g").to_pylist(), strict=True)):
                sums, p, times, above = (b.column(c)[i].values.to_numpy() for c in ("sums", "p", "times", "above"))
                best = list(zip((-above).tolist(), b.column("terms")[i].values.cast(pa.binary()).to_pylist(), strict=True))
                if key == now:
                    held = held[0] + sums, np.concatenate([held[1], p]), np.concatenate([held[2], times]), held[3] + best
                    if len(held[1]) > TILE or len(held[3]) > TILE:
                        held = held[0], *summed(held[1], held[2]), sorted(held[3])[:top]
                else:
                    if now:
                        yield whole(*now, *held)
                    now, held = key, (sums, p, times, best)
        if now:
            yield whole(*now, *held)

    return parts.repartition("lang", "g").sortWithinPartitions("lang", "g").mapInArrow(run, "lang string, g int, h int, value long, term string, rank int")


def audited(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, heavy: int = HEAVY, slab_cells: int = SLAB_CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source by divergence, and each group's ``top`` terms above its language."""
    spark = documents.sparkSession
    names = documents.select(*(F.coalesce(F.col(c), F.lit("")).cast("string").alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = sorted((r.lang, r.source) for r in names.toLocalIterator())
    postings = stored(term_lists(documents, groups, least_docs, text_col, lang_col, source_col), "postings")
    totals = {r.g: r.total for r in postings.select(F.explode(F.arrays_zip("g", "n")).alias("x")).groupBy("x.g").agg(F.sum("x.n").alias("total")).toLocalIterator()}
    sizes = {r.lang: r.v for r in postings.groupBy("lang").agg(F.count("*").alias("v")).toLocalIterator()}
    of: dict[str, list[int]] = defaultdict(list)
    for i, (lang, _) in enumerate(groups):
        of[lang].append(i)
    langs = {lang: _Lang(own[0], [totals.get(i, 0) for i in own], sizes[lang]) for lang, own in of.items() if lang in sizes}
    parts = stored(compared(postings, langs, top, heavy, slab_cells), "parts")
    sums = stored(met(parts, langs, top), "sums")
    forget(postings, parts)

    placed = spark.createDataFrame([(lang, i - of[lang][0], source) for i, (lang, source) in enumerate(groups)], "lang string, g int, source string")
    own, other = F.broadcast(placed), F.broadcast(placed.select("lang", F.col("g").alias("h"), F.col("source").alias("item")))
    values = sums.where("h is not null").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = own.join(other, "lang").where("g <> h").join(values, ["lang", "g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = sums.where("h is null").join(own, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def _oracle() -> str:
    p = lambda n, total: f"1 + ({SCALE}::hugeint * ({n} + 2)) // ({total} + 2 * v)"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), found as (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (select lang, term from found group by lang, term having count(distinct doc) >= {LEAST_DOCS}
), sizes as (select lang, count(*) as v from kept group by lang
), counts as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by lang, source, term
), groups as (
  select g.lang, g.source, coalesce(v, 0) as v, coalesce(total, 0) as total, sum(coalesce(total, 0)) over (partition by g.lang) as whole
  from (select distinct lang, source from docs) g left join sizes using (lang)
  left join (select lang, source, sum(n) as total from counts group by lang, source) t on t.lang = g.lang and t.source = g.source
), probabilities as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, cast({p("coalesce(c.n, 0)", "total")} as bigint) as p
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select g.lang, g.source, h.source as item, cast(coalesce(sum({f}), 0) as bigint) as value
  from groups g join groups h on h.lang = g.lang and h.source <> g.source
  left join (select a.lang, a.source as s, b.source as o, a.p, b.p as q from probabilities a join probabilities b on a.lang = b.lang and a.term = b.term) x
    on x.lang = g.lang and x.s = g.source and x.o = h.source
  group by g.lang, g.source, h.source
), wholes as (
  select c.lang, c.term, cast({p("sum(c.n)", "any_value(whole)").replace("* v)", "* any_value(v))")} as bigint) as q
  from counts c join (select distinct lang, v, whole from groups) g on g.lang = c.lang group by c.lang, c.term
), terms as (
  select lang, source, term as item, cast({f} as bigint) as value from probabilities join wholes using (lang, term) where n > 0 and p > q
), parts as (
  select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms
), ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from parts
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}
"""


ORACLE_SQL = _oracle()
