"""Operator 2: best-two-fit packing of token pieces into fixed-length sequences.

Only how many pieces have each length matters to a packing, and there are at most ``capacity`` lengths. So the plan is
made from those counts: fill a bin greedily (the longest piece that fits, again and again), then, while it has a gap,
replace its smallest piece with two unpacked ones that fit the expanded gap more tightly. The same bin is then packed as
often as the counts allow, which is what bin-by-bin packing would do too, so a plan has a few thousand rows for any
input. The pieces get their places by their rank within their length, by a join with the plan.

Nulls: a null text counts as empty (its document is the end id alone); a null doc_id is an id of its own. Repeated rows
are packed each. Empty tables give no row. Extra columns are ignored. Ties in length are broken by doc_id and piece, then
in any way.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, id_text, stored
from kgloom.llm.tokens import encoder

CAPACITY = 2048
#: Pieces that are ranked in one window, about.
RANKED = 100_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each whole document, cut only beyond ``capacity``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            out = []
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for doc_id, ids in zip(doc_ids, e.encode_many(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(own), zlib.crc32(own.astype("<u4").tobytes()), *([own.tolist()] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return id_text(docs).mapInArrow(run, schema)


def fill(count: np.ndarray, capacity: int) -> list[int]:
    """One bin from the lengths that ``count`` still has: greedy, then smallest-for-two exchanges."""
    left, bin_, gap = count.copy(), [], capacity

    def longest(most: int) -> int:
        found = np.flatnonzero(left[: most + 1])
        return int(found[-1]) if len(found) else 0

    while gap and (length := longest(gap)):
        n = min(int(left[length]), gap // length)
        bin_ += [length] * n
        left[length] -= n
        gap -= n * length
    while gap and bin_:
        small = bin_[-1]
        room = gap + small
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            break
        # for each first piece the longest second one that fits; a piece may pair with its own length if there are two
        at = np.searchsorted(have, room - have, "right") - 1
        second = np.where(at >= 0, have[np.maximum(at, 0)], 0)
        alone = (second == have) & (left[have] < 2)
        second = np.where(alone, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), second)
        total = np.where(second > 0, have + second, 0)
        best = int(total.argmax())
        if total[best] <= small:
            break
        pair = (int(have[best]), int(second[best]))
        left[small] += 1
        left[pair[0]] -= 1
        left[pair[1]] -= 1
        bin_ = sorted([*bin_[:-1], *pair], reverse=True)
        gap = room - sum(pair)
    return bin_


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first rank, past rank, pieces a bin, first bin, offset`` for runs of equal bins."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    taken, rows, bins = np.zeros(capacity + 1, np.int64), [], 0
    while count.any():
        need = Counter(fill(count, capacity))
        times = min(int(count[length]) // n for length, n in need.items())
        at = 0
        for length in sorted(need, reverse=True):
            n = need[length]
            rows.append((length, int(taken[length]), int(taken[length]) + n * times, n, bins, at))
            taken[length] += n * times
            count[length] -= n * times
            at += n * length
        bins += times
    return rows


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to rows with ``doc_id, piece, length``; ``parts`` should be a stored table."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    plan_rows = spark.createDataFrame(rows, "length long, lo long, hi long, each long, first long, at long")
    shards = max(1, sum(counts.values()) // RANKED)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    sizes = dealt.groupBy("length", "shard").count()
    ahead = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "shard", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    local = dealt.withColumn("nth", F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1)
    ranked = local.join(before, ["length", "shard"]).withColumn("rank", F.col("nth") + F.col("before"))
    # a plan has at most a few rows for each of ``capacity`` lengths
    met = ranked.alias("p").join(F.broadcast(plan_rows.alias("q")), (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return met.select(*(F.col(f"p.{c}") for c in parts.columns), (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("p.length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents; a row a piece."""
    return place(stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id, ids``, of placed pieces with ids; at most ``capacity`` ids each."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"))
