"""Operator 10: exact n-gram Jaccard join by PartEnum signatures, to components.

Sets with ``100 * intersection >= percent * union`` and sizes a <= b differ in at most ``(a + b)(100 - percent) / (100 +
percent)`` elements. Sizes fall in bands; band i's signatures find the pairs whose larger set is in it. So a set signs
for its own band and, as the smaller one, for the next. For a band with at most k differences, the hashed feature domain
has k + 2 parts, of which a similar pair has two alike at least. A signature stands for one part's whole content, or,
where a part holds too few elements to tell sets apart, for two such parts together: whichever two parts are alike, the
pair shares a signature. No bucket is cut.

Equal sets are one class first. Signatures are shuffled as packed, sorted blobs, each in the range of its leading bits; a signature that
many documents of one task share is led by the least of them there, so that a hot one sends a row a task. In each bucket the
smallest id leads, and every member is paired with it. Pairs whose sets' parities (a bit for each of two to four times as many cells as elements) differ too often
can't link and go before any text is read; what stays is compared exactly over whole sets of 64-bit shingle hashes. Then the members
of buckets that still hold several components are held against each other, by parities and exactly, in blocks of at most ``BLOCK`` members.
Parities and texts are sent to groups of pairs that have the same documents in common, once a group and not once a pair.

Nulls: a null text has an empty set, linked with nothing; a null doc_id is linked with nothing and has a null component.
Repeated rows are copies of one document. Rows that share a doc_id but not the text are one document, compared by the text whose set has
the least key. Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, forget, id_text, stored
from kgloom.llm.components import components
from kgloom.llm.shingles import mixed, shingle_set

#: Up to so many ids (16 bytes each) are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Signatures that a task packs at once, and about how many a bucket of them holds.
PACKED = 1_000_000
BUCKET = 500_000
#: A signature of so many documents among those packed at once is led by one of them.
HOT = 64
#: Pairs, members of torn buckets and bytes of text in a group, about.
PAIRS, MEMBERS, TEXT = 50_000, 100_000, 16_000_000
#: Members of a bucket that are held against each other at once.
BLOCK = 1000
#: Pairs of places that a task makes at once, and rows that it sends on at once.
AT_ONCE, ROWS = 1_000_000, 250_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@cache
def _bands(percent: int, most: int) -> np.ndarray:
    """The first sizes of the bands, up to one beyond ``most``."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array([*lows, lows[-1] * 100 // percent + 1])


@cache
def _weak(parts: int, high: int) -> int:
    """Parts with so many elements at most sign in twos: 2, 1 or 0, as many as keep the twos few beside the single parts."""
    mean = high / parts
    return next((t for t in (2, 1) if parts * (math.exp(-mean) * sum(mean**j / math.factorial(j) for j in range(t + 1))) ** 2 <= 0.6), 0)


def pairs_within(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all twos inside each of the segments that follow each other."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(ends))
    after = ends - 1 - place
    i = np.repeat(place, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments that follow each other, each of one segment or of about ``AT_ONCE`` pairs at most."""
    load, at = np.cumsum(lengths * lengths), 0
    while at < len(lengths):
        past = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, past
        at = past


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of ascending shingle sets, and which set each is of."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lows = _bands(percent, 1 << int(sizes.max()).bit_length())
    band = np.searchsorted(lows, sizes, "right") - 1
    # an instance is a set in its own band, or in the next as the smaller one of a pair
    next_too = (sizes > 0) & (sizes * 100 // percent >= lows[band + 1])
    of = np.concatenate([np.flatnonzero(sizes), np.flatnonzero(next_too)])
    its_band = np.concatenate([band[sizes > 0], band[next_too] + 1])
    high = lows[its_band + 1] - 1
    parts = 2 * high * (100 - percent) // (100 + percent) + 2
    weak = np.array([_weak(int(p), int(h)) for p, h in zip(parts, high, strict=True)])
    starts = np.cumsum(parts) - parts
    shingles = np.concatenate([sets[k] for k in of])
    instance = np.repeat(np.arange(len(of)), sizes[of])
    cell = starts[instance] + (((shingles >> np.uint64(32)) * parts[instance].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # ascending with the shingles
    content, count = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), np.int64)
    content[cell[cuts]] = np.add.reduceat(mixed(shingles + np.uint64(1)), cuts)
    count[cell[cuts]] = np.diff(np.append(cuts, len(cell)))
    instance = np.repeat(np.arange(len(of)), parts)
    number = (np.arange(len(content)) - starts[instance] + 1).astype(np.uint64)
    content = mixed(content + number * _GOLDEN + (its_band[instance].astype(np.uint64) << np.uint64(40)))
    few = count <= weak[instance]
    i, j = pairs_within(np.bincount(instance[few], minlength=len(of)))
    twos, their = content[few], instance[few]
    return np.concatenate([content[~few], mixed(twos[i] * np.uint64(3) + twos[j] * np.uint64(5))]), of[np.concatenate([instance[~few], their[i]])]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the set has an odd number of elements in each of so many cells, as bits in 64-bit words. An element that only one of
    two sets has changes one bit, so sets differ in as many elements as bits at least. Cells are a power of two; halves of the
    words laid over each other are the parities of half as many."""
    cells = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Sketches:
    """Sizes and parities of some documents."""

    def __init__(self, sizes: np.ndarray, words: list[bytes]):
        self.sizes = sizes
        self.width = np.array([len(w) // 8 for w in words], np.int64)
        self.row = np.zeros(len(words), np.int64)
        self.of_width = {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.of_width[int(w)] = np.frombuffer(b"".join(words[k] for k in own), np.uint64).reshape(len(own), w)

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets of ``a`` and ``b``, as places, may be similar: no more differing parities than linked sets of the two sizes
        can have differing elements."""
        both = self.sizes[a] + self.sizes[b]
        out = 100 * np.minimum(self.sizes[a], self.sizes[b]) >= percent * np.maximum(self.sizes[a], self.sizes[b])
        for x in self.of_width:
            for y in (w for w in (x, 2 * x) if w in self.of_width):
                at = np.flatnonzero(out & (np.minimum(self.width[a], self.width[b]) == x) & (np.maximum(self.width[a], self.width[b]) == y))
                step = max(1, 2_000_000 // y)
                for k in range(0, len(at), step):
                    own = at[k : k + step]
                    small = np.where(self.width[a[own]] == x, a[own], b[own])
                    large = a[own] + b[own] - small
                    rows = self.of_width[y][self.row[large]]
                    if y > x:
                        rows = rows[:, :x] ^ rows[:, x:]
                    bits = np.bitwise_count(rows ^ self.of_width[x][self.row[small]]).sum(axis=1, dtype=np.int64)
                    out[own] = bits * (100 + percent) <= both[own] * (100 - percent)
        return out


_SETS = "doc_id long, n_shingles long, key binary, bits binary"


def _sets(docs: DataFrame, n: int) -> DataFrame:
    arrow = arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                s = shingle_set(x.as_py(), n)
                rows.append((len(s), *((xxhash.xxh3_128_digest(s.tobytes()), parities(s).tobytes()) if len(s) else (None, None))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(3))], schema=arrow)

    return docs.mapInArrow(run, _SETS)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, by planes of their bytes: leading zeros cost nothing."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def _led_rows(sig: np.ndarray, ids: np.ndarray, least: int = 2) -> tuple[np.ndarray, ...]:
    """Of (signature, id) in order: rows ``signature, leader, member`` of the signatures that ``least`` ids share, and where those start and how many they have."""
    cuts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.append(cuts, len(sig)))
    cuts, count = cuts[count >= least], count[count >= least]
    place = np.repeat(cuts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lead = np.repeat(cuts, count)
    rest = place != lead
    return sig[place[rest]], ids[lead[rest]], ids[place[rest]], place[rest]


def _in_order(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (signature, id), by signature, then id as a signed number."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])]) if len(sig) else np.zeros(0, bool)
    return sig[keep], ids[keep]


def _led(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """``sig, a, b``: the members b of each bucket of two documents or more with their leader a (in a hot bucket, one of several leaders, led in turn)."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    sent = arrow_schema("bucket long, blob binary")

    def pack(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        # 32 bits within the bucket: one in some thousand buckets of a real corpus joins two signatures, which costs a comparison
        sig, ids = _in_order(sig >> (shift - np.uint64(32)), ids)
        hot_sig, lead, member, place = _led_rows(sig, ids, HOT)
        out = [(-1 - int(hot_sig[0] % np.uint64(1 << 20)), _packed(hot_sig, lead.view(np.uint64), member.view(np.uint64)))] if len(place) else []
        sig, ids = np.delete(sig, place), np.delete(ids, place)
        which = sig >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(sig) else []
        for at, past in zip(cuts, [*cuts[1:], len(sig)], strict=True):
            base = int(ids[at:past].min())
            own = sig[at:past] & np.uint64(0xFFFFFFFF)
            gaps = np.diff(own, prepend=np.uint64(0))
            out.append((int(which[at]), base.to_bytes(8, "little", signed=True) + _packed(gaps, (ids[at:past] - base).view(np.uint64))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], schema=sent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, sets, ids, size = [], 0, [], [], 0

        def signed() -> None:
            nonlocal total, size
            sig, of = signatures(sets, percent)
            held.append((sig, np.array(ids, np.int64)[of]))
            total += len(sig)
            sets.clear(), ids.clear()
            size = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                sets.append(shingle_set(text.as_py(), n))
                ids.append(doc_id.as_py())
                size += len(sets[-1])
                if size > 200_000:
                    signed()
                    if total > PACKED:
                        yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, total = [], 0
        if sets:
            signed()
        if held:
            yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))

    rows = arrow_schema("sig long, a long, b long")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if now is not None and now >= 0:
                sig = np.concatenate([np.cumsum(x[0]) for x in held])
                own = _led_rows(*_in_order(sig, np.concatenate([x[1] for x in held])))
                own = (own[0] | np.uint64(now << 32), own[1], own[2])
                for k in range(0, len(own[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS].view(np.int64)) for c in own], schema=rows)
            held.clear()

        for batch in batches:
            for bucket, blob in zip(batch.column(0), batch.column(1), strict=True):
                bucket, blob = bucket.as_py(), blob.as_py()
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in _unpacked(blob, 3)], schema=rows)
                    continue
                if bucket != now:
                    yield from found()
                now = bucket
                gaps, ids = _unpacked(blob[8:], 2)
                held.append((gaps, ids.view(np.int64) + int.from_bytes(blob[:8], "little", signed=True)))
        yield from found()

    return docs.mapInArrow(sign, "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lead, "sig long, a long, b long")


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id is among those of ``node`` (or isn't), which are broadcast only if counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["node"], how)


def _grouped(pairs: DataFrame, weight: str, most: int) -> DataFrame:
    """Add a group ``g``, of about ``most`` of the summed column ``weight``, to rows with a root ``r`` and a deal ``d``: rows of one root are together
    unless they are more than that."""
    total = pairs.agg(F.sum(weight)).first()[0] or 0
    hot = pairs.groupBy("r").agg(F.ceil(F.sum(weight) / most).alias("shards")).where("shards > 1")
    hot = F.broadcast(hot) if total // most <= BROADCAST_IDS else hot  # no more roots can be hot than that
    dealt = pairs.join(hot, "r", "left").withColumn("shard", F.when(F.col("shards").isNotNull(), F.pmod("d", "shards")))
    return dealt.withColumn("g", F.pmod(F.xxhash64("r", "shard"), F.lit(total // most + 1))).drop("shards", "shard")


def _by_group(keyed: DataFrame, nodes: list[str], own: Callable[[DataFrame], DataFrame], keep: Callable[[pa.Table, pa.Table], list[np.ndarray]]) -> DataFrame:
    """Pairs ``a, b`` that ``keep`` finds in each group of ``keyed``, given what ``own`` joins to ``h, node`` (group, document) of the documents the group names in ``nodes``."""
    needs = keyed.select(F.col("g").alias("h"), F.explode(F.array(*nodes)).alias("node")).distinct()
    schema = arrow_schema("a long, b long")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in keep(left, right)], schema=schema)

    return keyed.groupBy("g").cogroup(own(needs).groupBy("h")).applyInArrow(run, "a long, b long")


def _places(nodes: np.ndarray, x: pa.ChunkedArray) -> np.ndarray:
    return np.searchsorted(nodes, x.to_numpy())


def _sketches(right: pa.Table) -> tuple[np.ndarray, Sketches]:
    right = right.sort_by("node")
    return right["node"].to_numpy(), Sketches(right["size"].to_numpy(), right["bits"].to_pylist())


def _likely(keyed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that parities allow."""

    def keep(left: pa.Table, right: pa.Table) -> list[np.ndarray]:
        nodes, sketches = _sketches(right)
        a, b = _places(nodes, left["a"]), _places(nodes, left["b"])
        on = sketches.may_link(a, b, percent)
        return [nodes[a[on]], nodes[b[on]]]

    return _by_group(keyed, ["a", "b"], lambda needs: needs.join(sizes, "node"), keep)


def _verified(pairs: DataFrame, roots: DataFrame, sizes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the stored pairs ``a, b`` by whole sets; pairs that others of their group connect already are left out."""
    size = lambda c: sizes.select(F.col("node").alias(c), (F.col("size") * 8).alias(f"size_{c}"))
    weighed = pairs.join(size("a"), "a").join(size("b"), "b").join(roots, "b", "left").select("a", "b", F.coalesce("r", "a").alias("r"), F.xxhash64("b").alias("d"), (F.col("size_a") + F.col("size_b")).alias("bytes"))
    keyed = stored(_grouped(weighed, "bytes", TEXT).select("g", "a", "b"), "verify")

    def own(needs: DataFrame) -> DataFrame:
        few = needs.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(needs) if few else needs, docs["doc_id"] == needs["node"]).select("h", "node", "text")

    def keep(left: pa.Table, right: pa.Table) -> list[np.ndarray]:
        sets: dict[int, np.ndarray] = {}
        for node, text in zip(right["node"], right["text"], strict=True):
            node, s = node.as_py(), shingle_set(text.as_py(), n)
            if len(s) and (node not in sets or xxhash.xxh3_128_digest(s.tobytes()) < xxhash.xxh3_128_digest(sets[node].tobytes())):
                sets[node] = s
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        links = []
        left = left.sort_by([("a", "ascending"), ("b", "ascending")])
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                x, y = sets[a], sets[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    links.append((a, b))
                    top[max(ra, rb)] = min(ra, rb)
        return [np.array([p[i] for p in links], np.int64) for i in range(2)]

    links = stored(_by_group(keyed, ["a", "b"], own, keep), "links")
    forget(keyed)
    return links


def _torn_pairs(torn: DataFrame, roots: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members ``sig, node, part`` of one bucket, but of different parts, that parities allow."""
    of_sig = torn.groupBy("sig").agg(F.count("*").alias("c"), F.min("node").alias("b"))
    of_sig = of_sig.join(roots, "b", "left").select("sig", F.coalesce("r", "b").alias("r"), F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    rows = torn.join(of_sig, "sig").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("r", "sig", "node", "part", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.lit(1).alias("one"))
    keyed = stored(_grouped(rows.withColumn("d", F.xxhash64("sig", "x", "y")), "one", MEMBERS).select("g", "sig", "x", "y", "node", "part", "own"), "blocks")

    def keep(left: pa.Table, right: pa.Table) -> list[np.ndarray]:
        nodes, sketches = _sketches(right)
        left = left.sort_by([(c, "ascending") for c in ("sig", "x", "y", "node")])
        sig, x, y, part, own = (left[c].to_numpy() for c in ("sig", "x", "y", "part", "own"))
        node = _places(nodes, left["node"])
        cuts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        lengths = np.diff(np.append(cuts, len(sig)))
        done = np.zeros((0, 2), np.int64)
        for at, past in runs(lengths):
            i, j = pairs_within(lengths[at:past])
            i, j = i + cuts[at], j + cuts[at]
            on = (part[i] != part[j]) & ((x[i] == y[i]) | (own[i] != own[j])) & (node[i] != node[j])
            two = np.unique(node[i[on]] * len(nodes) + node[j[on]])
            a, b = two // len(nodes), two % len(nodes)
            on = sketches.may_link(a, b, percent)
            done = np.unique(np.concatenate([done, np.stack([nodes[a[on]], nodes[b[on]]], axis=1)]), axis=0)
        return [done[:, 0], done[:, 1]]

    found = stored(_by_group(keyed, ["node"], lambda needs: needs.join(sizes, "node"), keep).distinct(), "apart")
    forget(keyed)
    return found


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see the module."""
    docs = id_text(documents)
    sets = stored(_sets(docs, n), "sets")
    known = sets.where("doc_id is not null and key is not null")
    key_of = known.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    several = stored(key_of.where("key <> last").select(F.col("doc_id").alias("node"), F.col("key").alias("least")), "several")
    if several.take(1):
        known = known.join(several, known["doc_id"] == several["node"], "left").where("least is null or least = key").select(*sets.columns)
    classes = stored(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    first = known.join(classes, (known["key"] == classes["key"]) & (known["doc_id"] == classes["rep"]), "left_semi")
    sizes = first.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "bits").dropDuplicates(["node"])
    copies = known.join(classes, "key").where("doc_id <> rep").select(F.col("doc_id").alias("node")).distinct()
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 1 << max(6, (total // BUCKET).bit_length())
    led = stored(_led(_picked(docs.where("doc_id is not null"), copies, "left_anti"), n, percent, buckets), "led")
    pairs = stored(led.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    roots = stored(pairs.groupBy("b").agg(F.min("a").alias("r")), "roots")
    keyed = _grouped(pairs.join(roots, "b").withColumns({"d": F.xxhash64("b"), "one": F.lit(1)}), "one", PAIRS)
    keyed = stored(keyed.select("g", "a", "b"), "keyed")
    near = stored(_likely(keyed, sizes, percent), "near")
    forget(pairs, keyed)
    links = _verified(near, roots, sizes, docs, n, percent)
    parts = stored(components(links), "components")
    # buckets that still hold several components: their members against each other
    members = led.select("sig", F.col("b").alias("node")).union(led.select("sig", "a").distinct())
    labelled = members.join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    torn = labelled.groupBy("sig").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("sig")
    torn = stored(labelled.join(torn, "sig", "left_semi"), "torn")
    forget(led)
    left = stored(_torn_pairs(torn, roots, sizes, percent).join(near, ["a", "b"], "left_anti"), "left")
    forget(torn)
    more = _verified(left, roots, sizes, docs, n, percent)
    if more.take(1):
        parts = stored(components(links.union(more)), "components")
    forget(near, left)
    own = known.select("doc_id", "key").join(classes, "key").select(F.col("doc_id").alias("id"), "rep").distinct() if several.take(1) else None
    joined = sets.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    if own is not None:
        joined = joined.drop("rep").join(own, F.col("doc_id") == F.col("id"), "left")
    joined = joined.join(parts, F.col("rep") == F.col("node"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def first_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component, the smallest id's, as they are. Of rows that repeat a doc_id and its text one
    stays; rows with a null doc_id stay."""
    found = stored(near_duplicates(documents, n, percent).select("doc_id", "component_id"), "found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct()
    kept = _picked(documents, gone, "left_anti")
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("node")).count().where("count > 1").select("node")
    again = stored(again, "again")
    if not again.take(1):
        return kept
    return _picked(kept, again, "left_anti").unionByName(_picked(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))
