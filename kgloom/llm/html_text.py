"""Operator 6: main text of HTML pages by nearest-URL page differencing.

A page's markup is read into blocks of text (lines) with the kind of place they stand in: inside an article or main element,
in a part that is never main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments), or
open, where the markup doesn't tell. Open lines are decided by differencing: the distinct URLs of each host are put in order of
path and URL, each is paired with the neighbour whose path shares the longer beginning (the earlier one on a tie), the
page's open lines are aligned with that URL's by their longest common subsequence, and the shared ones go: a template's lines recur
on the next page, an article's don't. Lines inside an article or main element stay even if the neighbour has them, since articles quote
and repeat each other.

Copies of a page are one URL, so a page never meets itself, and equal pages get equal text. Of different pages under one URL the one
with the smallest id, then the smallest line hashes, stands for the URL. Pages without open lines need no neighbour and aren't shuffled.
Pairing needs no host in one task: URLs are sorted by range, each range pairs its own neighbours, and the URLs at its
two ends meet those of the next ranges in a table of two rows a range.

Nulls: a null html gives an empty text; a null url has an empty host and path and is one URL beside the others without a host. Repeated
rows and repeated or null page_ids give a row each. Empty tables give no row. Extra columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, stored
from kgloom.llm.urls import host, path

_START = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:([^<>\"']*+)(>))?|<[!?]", re.S | re.I)
_MARK = re.compile(r"[>\"']")
_LONG_CODE = re.compile(r"&#([0-9]{1000,});?")
_HINT = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
# Elements of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_APART = frozenset("nav header footer aside form button head dialog menu".split())
_MAIN = frozenset("article main".split())
_APART_HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo".split())
_MAIN_HINTS = frozenset("article-body articlebody entry-content post-content post-body story-body main-content main".split())
# Names that an article's own parts bear too ("post-header", "related-work"): below a main element they count whole, and not as an id.
_LOOSE_HINTS = frozenset("banner consent footer form header login menu notice notices related replies reply respond search social".split())
_WORDS = re.compile(r"[a-z0-9]+")


def _place(tag: str, attributes: str, above: str) -> str:
    """Where an element's content stands: "apart", "main" or "open"."""
    if above == "apart" or tag in _APART and not (tag == "header" and above == "main"):
        return "apart"
    for m in _HINT.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        # a name counts whole, or by its first or last word: "ad-slot", "site-footer"
        parts = {w for n in names for w in (n, (_WORDS.findall(n) or [""])[0], (_WORDS.findall(n) or [""])[-1])}
        if above == "main":
            parts -= _LOOSE_HINTS - (set() if m[1].lower() == "id" else set(names))
        if tag not in _MAIN and tag not in ("body", "html") and parts & _APART_HINTS:
            return "apart"
        if set(names) & _MAIN_HINTS:
            return "main"
    return "main" if tag in _MAIN else above


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag in page order; comments, declarations and elements without text have an empty name. A
    ``<`` that no tag follows is text.

    A tag ends at the first ``>`` outside quotes; a quote that nothing closes is a letter. The time is linear in the page: where a tag isn't
    closed, the quotes on its way are remembered, since each later way that meets one of them can't end either.
    """
    dead: set[int] = set()
    mark, closing = -1, True

    def end_of_tag(at: int) -> int:
        nonlocal mark
        if mark < at:  # else the next mark is still the one found before
            mark = m.start() if (m := _MARK.search(page, at)) else len(page)
        here, way = mark, []
        while here < len(page) and here not in dead:
            if page[here] == ">":
                return here + 1
            way.append(here)
            closed = page.find(page[here], here + 1)
            m = _MARK.search(page, max(closed, here) + 1)
            here = m.start() if m else len(page)
        dead.update(way)
        return -1

    at = 0
    while m := _START.search(page, at):
        at = m.end()
        if m[5]:  # no quotes
            yield m.start(), at, m[2], m[3].lower(), m[4]
        elif m[3]:
            end = end_of_tag(at)
            if end > 0:
                yield m.start(), end, m[2], m[3].lower(), page[at : end - 1]
                at = end
        elif m[0] in ("<!", "<?"):
            end = page.find(">", at) if closing else -1
            closing = end >= 0
            if closing:
                yield m.start(), end + 1, "", "", ""
                at = end + 1
        else:
            yield m.start(), at, "", "", ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of each block in page order; white space is one space, empty blocks are left out."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    own: list[str] = []
    at, place = 0, "open"

    def end_block() -> None:
        if own:
            text = _LONG_CODE.sub(lambda m: f"&#{m[1].lstrip('0')[:10] or 0};", "".join(own))
            text = " ".join(html.unescape(text).split())
            if text:
                out.append((place, text))
            own.clear()

    def close() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    for start, end, slash, tag, attributes in tags(page):
        if start > at:
            own.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            own.append(" ")
        if tag not in _INLINE:
            end_block()
        if slash:
            if opened[tag]:
                while close() != tag:
                    pass
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                close()
            new = _place(tag, attributes, place)
            if new != place:
                end_block()
            stack.append((tag, new))
            opened[tag] += 1
        now = stack[-1][1] if stack else "open"
        if now != place:
            end_block()
        place = now
    if at < len(page):
        own.append(page[at:])
    end_block()
    return out


def lcs_marks(a: list[int], b: list[int]) -> list[bool]:
    """Which elements of ``a`` are in a longest common subsequence with ``b``.

    A row of lengths is a number whose bit j is 0 where the length grows at ``b[j]``, and a row follows from the one before by
    one addition. Every so many rows are kept, and those between are made again on the way back, so memory grows with
    ``len(b) * sqrt(len(a))`` bits.
    """
    marks = [False] * len(a)
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    at = [i for i, x in enumerate(a) if x in where]  # no other line can match
    every = max(1, math.isqrt(len(at)))
    full = (1 << len(b)) - 1

    def rows(first: int, row: int) -> list[int]:
        found = []
        for i in at[first : first + every]:
            found.append(row)
            met = row & where[a[i]]
            row = ((row + met) | (row - met)) & full
        return [*found, row]

    kept, row = [], full
    for first in range(0, len(at), every):
        kept.append(row)
        row = rows(first, row)[-1]
    j = len(b)
    for k in reversed(range(len(kept))):
        own = rows(k * every, kept[k])
        for i in reversed(range(len(own) - 1)):
            # the last place whose length grows by now; if it grew before this row too, the row adds nothing here
            j = (~own[i + 1] & ((1 << j) - 1)).bit_length()
            if not j:
                return marks
            if own[i] >> (j - 1) & 1:
                marks[at[k * every + i]] = True
                j -= 1
    return marks


_READ = "page_id long, url string, host string, path string, lines array<string>, main array<int>"


def read_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, host, path, lines, main``: a page's lines outside the parts that are never main text, and which stand in an article or
    main element (1) or are open (0)."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    arrow = arrow_schema(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(t, p) for p, t in blocks(x) if p != "apart"] for x in batch.column(4).to_pylist()]
            own = [[t for t, _ in x] for x in found], [[int(p == "main") for _, p in x] for x in found]
            yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(i).to_pylist(), arrow.field(i).type) for i in range(4)), pa.array(own[0], pa.list_(pa.string())), pa.array(own[1], pa.list_(pa.int32()))], schema=arrow)

    return base.mapInArrow(run, _READ)


def shared_start(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


_NEAR = "key string, host string, path string, hashes array<long>, part int, place int, before string, before_hashes array<long>, after string, after_hashes array<long>"


def neighbours(read: DataFrame) -> DataFrame:
    """``key, near``: for each distinct URL the open lines, as hashes, of the nearest other URL of its host; null without one."""
    hashes = F.transform(F.filter("lines", lambda x, i: F.get(F.col("main"), i) == 0), lambda x: F.xxhash64(x))
    page = F.struct(F.coalesce("page_id", F.lit(0)), hashes.alias("hashes"))
    urls = read.groupBy(F.coalesce("url", F.lit("")).alias("key"), "host", "path").agg(F.min(page).alias("page")).select("key", "host", "path", "page.hashes")
    dealt = urls.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    arrow = arrow_schema(_NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, last, place = TaskContext.get().partitionId(), None, None, 0

        def row(prev, now, after, place):
            near = [x if x and x[1] == now[1] else None for x in (prev, after)]
            return (*now, part, place, *(v for x in near for v in ((x[2], x[3]) if x else (None, None))))

        for batch in batches:
            out = []
            for now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept is not None:
                    out.append(row(last, kept, now, place))
                    place += 1
                last, kept = kept, now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(last, kept, None, -1 - place), arrow, strict=True)], schema=arrow)

    found = stored(dealt.mapInArrow(run, _NEAR), "neighbours")
    # place 0 is a range's first URL, a negative place its last; -1 is both. Two rows a range, whatever the input
    ends = found.where("place <= 0").select("part", "place", "host", "path", "hashes")
    order = W.orderBy("part", F.col("place") < 0)
    side = ends.select("part", "place", *(F.when(f("host").over(order) == F.col("host"), f(c).over(order)).alias(f"{name}_{c}") for name, f in (("lag", F.lag), ("lead", F.lead)) for c in ("path", "hashes")))
    met = found.join(side, ["part", "place"], "left")
    first, last = F.col("place").isin(0, -1), F.col("place") < 0
    ways = [F.when(at, F.col(f"{far}_{c}")).otherwise(F.col(own)) for at, far, names in ((first, "lag", ("before", "before_hashes")), (last, "lead", ("after", "after_hashes"))) for c, own in zip(("path", "hashes"), names, strict=True)]
    arrow_near = arrow_schema("key string, near array<long>")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, before, before_hashes, after, after_hashes in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                ahead = before is not None and (after is None or shared_start(own, before) >= shared_start(own, after))
                near.append(before_hashes if ahead else after_hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.list_(pa.int64()))], schema=arrow_near)

    return met.select("key", "path", *ways).mapInArrow(choose, "key string, near array<long>")


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, lines, n_open, n_shared``: the main text's lines of every row, how many of its lines the markup left open, and how many of
    those went as shared."""
    read = read_lines(pages)
    is_open = F.exists("main", lambda x: x == 0)
    zero = F.lit(0)
    whole = read.where(~is_open).select("page_id", "url", "lines", zero.alias("n_open"), zero.alias("n_shared"))
    left = read.where(is_open)
    near = stored(neighbours(left), "near")
    hashed = left.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))).join(near, F.coalesce("url", F.lit("")) == F.col("key"))
    schema = "page_id long, url string, lines array<string>, n_open int, n_shared int"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_open, n_shared = [], [], []
            for lines, main, hashes, near in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                at = [k for k, m in enumerate(main) if not m]
                gone = {k for k, m in zip(at, lcs_marks([hashes[k] for k in at], near or []), strict=True) if m}
                kept.append([x for k, x in enumerate(lines) if k not in gone])
                n_open.append(len(at))
                n_shared.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip((kept, n_open, n_shared), list(arrow)[2:], strict=True))], schema=arrow)

    return whole.unionByName(hashed.select("page_id", "url", "lines", "main", "hashes", "near").mapInArrow(run, schema))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_open, n_shared`` of every row."""
    text = F.array_join("lines", "\n")
    return decided(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_open", "n_shared")
