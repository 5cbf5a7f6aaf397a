"""Operator 1: token ids in static range-ANS blocks.

A corpus folder holds two Parquet tables, so that Spark's commit protocol makes a lost executor's half-written files
vanish and any store that Spark reads will do:

* ``frequencies``: one shared table ``id, freq, start`` whose frequencies sum to ``2**SCALE_BITS``;
* ``blocks``: one row a block: ``part`` (a range of doc_id), ``block`` (its number), the documents' ids and lengths, and ``payload``.

A block holds whole documents, closing at ``block_tokens`` ids, and is decodable alone. Payload (little-endian):
``b"RNB1"``, n_ids, lanes, step of checkpoints, n_checkpoints, n_words, crc32 of the ids (uint32 each), word position of
each checkpoint (uint32), lane states of each checkpoint (uint64), 32-bit words. Id ``i`` belongs to lane ``i % lanes``
at step ``i // lanes``. A checkpoint has all that is needed to decode from its step on, so the pieces between
checkpoints are decoded side by side.

Nulls: a null text counts as empty (its document has the end id alone); a null doc_id sorts first. Repeated rows and
repeated doc_ids are kept, each a document of its own. Empty tables give no block. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, forget, id_text, stored, work_dir
from kgloom.llm.tokens import encoder

SCALE_BITS = 20
LANES = 32
CHECKPOINT_STEPS = 512
BLOCK_TOKENS = 1 << 16
#: Blocks coded side by side in one NumPy call.
SIDE = 32
_LOW = 1 << 31
_HEAD = struct.Struct("<4sIIIIII")


class Table:
    """The shared frequency table: ids ascending, their frequencies and starts."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, scale_bits: int = SCALE_BITS):
        self.ids, self.scale = ids.astype(np.uint32), scale_bits
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.at = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
        self.at[ids] = np.arange(len(ids), dtype=np.uint32)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, scale_bits: int = SCALE_BITS) -> Table:
        """Frequencies in proportion to the counts, at least 1 each; the commonest id takes the rounding."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        if len(ids):
            assert len(ids) < 1 << scale_bits, "more ids than slots"
            freq = 1 + np.floor(counts * (((1 << scale_bits) - len(ids)) / counts.sum())).astype(np.int64)
            freq[counts.argmax()] += (1 << scale_bits) - freq.sum()
        else:
            freq = np.zeros(0, np.int64)
        return cls(ids, freq, scale_bits)

    @property
    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def _lane_steps(sizes: np.ndarray, lanes: int) -> np.ndarray:
    return np.maximum(0, (sizes[:, None] - np.arange(lanes) + lanes - 1) // lanes)


def encode_blocks(blocks: list[np.ndarray], t: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> list[bytes]:
    """One payload for each array of ids; all blocks and lanes advance together."""
    sizes = np.array([len(b) for b in blocks])
    steps = int(-(-sizes.max(initial=0) // lanes))
    count = _lane_steps(sizes, lanes)
    sym = np.zeros((len(blocks), steps * lanes), np.uint32)
    for row, ids in zip(sym, blocks, strict=True):
        row[: len(ids)] = t.at[ids]
    sym = sym.reshape(len(blocks), steps, lanes)
    words, sent = np.zeros(sym.shape, np.uint32), np.zeros(sym.shape, bool)
    state = np.full((len(blocks), lanes), _LOW, np.uint64)
    saved = np.zeros((-(-steps // every), len(blocks), lanes), np.uint64)
    up, limit = np.uint64(t.scale), np.uint64(63 - t.scale)
    for s in range(steps - 1, -1, -1):
        on, f, c = s < count, t.freq[sym[:, s]], t.start[sym[:, s]]
        full = on & (state >= f << limit)
        words[:, s], sent[:, s] = state & np.uint64(0xFFFFFFFF), full
        x = np.where(full, state >> np.uint64(32), state)
        q = x // f
        state = np.where(on, (q << up) + (x - q * f) + c, x)
        if s % every == 0:
            saved[s // every] = state
    out = []
    for b, ids in enumerate(blocks):
        own = -(-len(ids) // lanes)
        marks = -(-own // every)
        before = np.concatenate([[0], np.cumsum(sent[b, :own].sum(axis=1))])[: marks * every : every] if marks else np.zeros(0)
        body = words[b, :own][sent[b, :own]]
        out.append(_HEAD.pack(b"RNB1", len(ids), lanes, every, marks, len(body), zlib.crc32(ids.astype("<u4").tobytes())) + before.astype("<u4").tobytes() + saved[:marks, b].astype("<u8").tobytes() + body.astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes], t: Table) -> list[np.ndarray]:
    """The ids of each payload; all pieces between checkpoints are decoded side by side. A damaged block raises."""
    heads, states, points, first, counts, streams, base = [], [], [], [], [], [], 0
    for p in payloads:
        magic, n, lanes, every, marks, n_words, crc = _HEAD.unpack_from(p)
        if magic != b"RNB1" or len(p) != _HEAD.size + 4 * marks + 8 * marks * lanes + 4 * n_words:
            raise ValueError("not a whole token block")
        at = _HEAD.size
        point = np.frombuffer(p, "<u4", marks, at).astype(np.int64)
        states.append(np.frombuffer(p, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes))
        streams.append(np.frombuffer(p, "<u4", n_words, at + 4 * marks + 8 * marks * lanes))
        points.append(point + base)
        base += n_words
        first.append(np.arange(marks) * every)
        counts.append(np.repeat(_lane_steps(np.array([n]), lanes), marks, axis=0))
        heads.append((n, lanes, every, marks, crc))
    if len({h[1:3] for h in heads}) > 1:
        return [decode_blocks([p], t)[0] for p in payloads]
    lanes, every = heads[0][1:3]
    x, point = np.concatenate(states).astype(np.uint64), np.concatenate(points)
    first, count = np.concatenate(first)[:, None], np.concatenate(counts)
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    out = np.zeros((len(x), every, lanes), np.uint32)
    mask, down, last = np.uint64((1 << t.scale) - 1), np.uint64(t.scale), len(stream) - 1
    for s in range(every if len(x) else 0):
        on = first + s < count
        slot = x & mask
        sym = t.slots[slot]
        out[:, s] = sym
        y = t.freq[sym] * (x >> down) + slot - t.start[sym]
        need = on & (y < _LOW)
        nth = np.cumsum(need, axis=1)
        y = np.where(need, (y << np.uint64(32)) | stream[np.minimum(point[:, None] + np.maximum(nth - 1, 0), last)], y)
        point = point + nth[:, -1]
        x = np.where(on, y, x)
    result, at = [], 0
    for n, _, _, marks, crc in heads:
        ids = t.ids[out[at : at + marks].reshape(-1)[:n]] if n else np.zeros(0, np.uint32)
        at += marks
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a token block's checksum differs")
        result.append(ids)
    return result


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\0" + ids.astype("<u4").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    """Two bytes an id, or an odd length: a zero byte and four bytes an id."""
    return np.frombuffer(b, "<u4", offset=1) if len(b) % 2 else np.frombuffer(b, "<u2").astype(np.uint32)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int] | None = None) -> DataFrame:
    """``doc_id, ids`` (packed) of every whole text, the end id appended; with ``bounds`` also ``part``, how many of them are below the doc_id (null: 0)."""
    schema = "doc_id long, ids binary" + ("" if bounds is None else ", part int")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            ids = [_packed(np.append(x, np.uint32(end_id))) for x in e.encode_many(batch.column(1).to_pylist())]
            more = [] if bounds is None else [pa.array([0 if x is None else bisect_left(bounds, x) for x in batch.column(0).to_pylist()], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *more], schema=arrow)

    return docs.mapInArrow(run, schema)


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ascending doc_ids that cut the documents into about ``parts`` ranges; as many values, whatever the input."""
    if parts < 2:
        return []
    found = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in found})


def write_corpus(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 1, parts: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write all texts of ``docs`` (doc_id, text) in ascending doc_id order to the folder ``out_dir``."""
    spark = docs.sparkSession
    base = id_text(docs)
    parts = parts or max(1, base.rdd.getNumPartitions())
    bounds = id_bounds(base, parts)
    dealt = tokenised(base, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id")
    tokens = stored(dealt, "tokens")
    counts = (
        tokens.select("ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ).collect()  # at most one row an id of the vocabulary
    t = Table.of_counts(np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64))
    spark.createDataFrame([(int(i), int(f), int(s)) for i, f, s in zip(t.ids, t.freq, t.start, strict=True)], "id long, freq long, start long").coalesce(1).write.parquet(f"{out_dir}/frequencies")
    shared = spark.sparkContext.broadcast((t.ids, t.freq))
    schema = "part int, block long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
    arrow = arrow_schema(schema)

    def rows(group: list[tuple], t: Table) -> pa.RecordBatch:
        payloads = encode_blocks([np.concatenate([x[1] for x in docs]) for _, _, docs in group], t)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(part, k, sum(len(x[1]) for x in docs), [x[0] for x in docs], [len(x[1]) for x in docs], p) for (part, k, docs), p in zip(group, payloads, strict=True)], strict=True), arrow, strict=True)], schema=arrow)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(*shared.value)
        group, docs, size, at, k, widest = [], [], 0, None, TaskContext.get().partitionId() << 32, 0

        def whole() -> Iterator[pa.RecordBatch]:
            """Blocks are padded to the longest beside them, so a long one goes alone."""
            nonlocal group, docs, size, k, widest
            if group and max(widest, size) * (len(group) + 1) > 2 * SIDE * block_tokens:
                yield rows(group, t)
                group, widest = [], 0
            group.append((at, k, docs))
            widest = max(widest, size)
            docs, size, k = [], 0, k + 1
            if len(group) == SIDE:
                yield rows(group, t)
                group, widest = [], 0

        for batch in batches:
            for doc_id, ids, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (size >= block_tokens or part != at):
                    yield from whole()
                at = part
                docs.append((doc_id, _unpacked(ids)))
                size += len(docs[-1][1])
        if docs:
            yield from whole()
        if group:
            yield rows(group, t)

    # Files are sorted, so each task has a run of documents; a file of blocks is a part, in the order of its ids.
    made = tokens.select("doc_id", "ids", "part").mapInArrow(blocks, schema).repartitionById(len(bounds) + 1, "part")
    order = [F.element_at("doc_ids", 1).asc_nulls_first(), F.element_at("doc_ids", -1).asc_nulls_first(), "block"]
    made.sortWithinPartitions(*order).write.option("compression", "uncompressed").parquet(f"{out_dir}/blocks")
    forget(tokens)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for b in batch.column(0).to_pylist():
            ids = _unpacked(b)
            if (top := int(ids.max(initial=0))) >= len(counts):
                counts = np.concatenate([counts, np.zeros(top + 1 - len(counts), np.int64)])
            counts += np.bincount(ids, minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])


def read_corpus(spark: SparkSession, corpus_dir: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document of the files, ``start`` counted over all before it."""
    table = spark.read.parquet(f"{corpus_dir}/frequencies").orderBy("id").collect()  # at most one row an id of the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r.id for r in table], np.int64), np.array([r.freq for r in table], np.int64)))
    blocks = spark.read.parquet(f"{corpus_dir}/blocks")
    schema = "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE):
                cols = [c.to_pylist() for c in whole.slice(at, SIDE).columns]
                out = []
                for part, block, doc_ids, lengths, ids in zip(*cols[:4], decode_blocks(cols[4], t), strict=True):
                    ends = np.cumsum(lengths)
                    for doc_id, n, end in zip(doc_ids, lengths, ends.tolist(), strict=True):
                        own = ids[end - n : end]
                        out.append((part, block, end - n, doc_id, n, zlib.crc32(own.astype("<u4").tobytes()), *([own.tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    docs = blocks.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    sizes = blocks.select("part", "block", "n_ids", F.element_at("doc_ids", 1).alias("lo"), F.element_at("doc_ids", -1).alias("hi"))
    ahead = W.partitionBy("part").orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_first(), "block").rowsBetween(W.unboundedPreceding, -1)
    within = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("before"))
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a part
    sums, rows = 0, []
    for r in totals:
        rows.append((r.part, sums))
        sums += r.n
    parts = spark.createDataFrame(rows, "part int, ahead long")
    starts = within.join(F.broadcast(parts), "part").select("part", "block", (F.col("ahead") + F.col("before")).alias("first"))
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def corpus_dir(spark: SparkSession) -> str:
    return work_dir(spark, "token-file")
