"""The merge of a response's callbacks as they arrive, in state that its end empties.

Callbacks are rows ``response_id, callback_id, sent_at, expected, ts, answer, kedge_id, score``, one or more for each bound edge of a
callback; ``expected`` callbacks are awaited for ``wait`` seconds after ``sent_at``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kgloom.operators.checkpoints import new_folder

MERGED = "response_id long, outcome string, returned long, answer string, edges array<string>, score double, first_edge string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep maps and timers in a state store that can hold them."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before:
            spark.conf.set(_PROVIDER, before)
        else:
            spark.conf.unset(_PROVIDER)


Entries = dict[tuple[str, str], tuple[float, int, str]]  # by answer and edge: the best score, and the earliest time and callback


def _met(edges: Entries, rows: Iterable[tuple[str, str, float, int, str]]) -> Entries:
    """``edges`` with more rows ``answer, kedge_id, score, at, callback_id``."""
    for answer, edge, score, at, callback in rows:
        before = edges.get((answer, edge))
        edges[answer, edge] = (score, at, callback) if before is None else (max(before[0], score), *min(before[1:], (at, callback)))
    return edges


class SerialMerge(StatefulProcessor):
    """State of a response: the callbacks met, the entries of each batch that it took (one for each answer and edge, with the best score and the
    earliest place), and how many callbacks it awaits. Both are lists, so a batch is read and written at once, not row by row; a response that is
    whole within its first batch writes none. Its rows leave when all are back or when the timer fires; until then a closed response stays, so
    that what comes twice or late is passed over. The timer empties the state."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.met = handle.getListState("met", "callback_id string")
        self.edges = handle.getListState("edges", "answer string, kedge_id string, score double, at long, callback_id string")
        self.open = handle.getValueState("open", "expected long, returned long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows))
        at, callbacks = batch["at"].astype("datetime64[us]").astype("int64").tolist(), batch["callback_id"].tolist()
        opened = self.open.get()
        if opened is None:
            first = min(range(len(at)), key=lambda i: (at[i], callbacks[i]))
            expected, returned, closed = int(batch["expected"].iloc[first]), 0, False
            self.handle.registerTimer(int(batch["deadline"].iloc[first]) + 1)
        else:
            expected, returned, closed = opened
        if closed:
            return
        # a callback's rows come together; one that was met in an earlier batch is a repetition
        known = {c for (c,) in self.met.get()} if returned else set()
        fresh = set(callbacks) - known
        own = zip(batch["answer"].tolist(), batch["kedge_id"].tolist(), batch["score"].astype(float).tolist(), at, callbacks, strict=True)
        edges = _met({}, (r for r in own if r[4] in fresh) if known else own)
        done = returned + len(fresh) >= expected
        if done:
            yield self._rows(int(key[0]), "complete", returned + len(fresh), _met(edges, self.edges.get()) if returned else edges)
            if returned:
                self.edges.clear()
                self.met.clear()
        elif fresh:
            self.edges.appendList([(*place, *entry) for place, entry in edges.items()])
            self.met.appendList([(c,) for c in fresh])
        self.open.update((expected, returned + len(fresh), done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        _, returned, closed = self.open.get()
        if not closed:
            yield self._rows(int(key[0]), "timeout", returned, _met({}, self.edges.get()))
            self.edges.clear()
            self.met.clear()
        self.open.clear()

    def _rows(self, response: int, outcome: str, returned: int, edges: Entries) -> pd.DataFrame:
        by: dict[str, list] = {}
        for (answer, edge), (score, at, callback) in edges.items():
            by.setdefault(answer, []).append((edge, score, (at, callback, edge)))
        rows = [(response, outcome, returned, a, sorted(e for e, _, _ in own), max(s for _, s, _ in own), min(p for _, _, p in own)[2]) for a, own in sorted(by.items())]
        return pd.DataFrame(rows, columns=["response_id", "outcome", "returned", "answer", "edges", "score", "first_edge"])

    def close(self) -> None:
        pass


def gathered(stream: DataFrame, name: str) -> DataFrame:
    """All rows that an appending stream gives for what its source holds now, as a table in the shared folder. A batch's rows are one
    folder of it, so a repeated batch replaces its own."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/result/batch=-1")

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/result/batch={batch}")

    with map_state(spark):
        run = stream.writeStream.outputMode("append").foreachBatch(replace).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/result").select(*stream.columns)


def _within(callbacks: DataFrame, wait: int) -> DataFrame:
    """Whole callbacks that came in time; rows without a response, callback, answer or edge are none."""
    own = callbacks.withColumn("at", F.col("ts").cast("timestamp")).withColumn("sent", F.col("sent_at").cast("timestamp"))
    deadline = F.unix_millis("sent") + wait * 1000
    in_time = own.withColumn("deadline", deadline).where(F.unix_millis("at") <= F.col("deadline"))
    return in_time.dropna(subset=["response_id", "callback_id", "answer", "kedge_id", "expected"]).select("response_id", "callback_id", F.col("expected").cast("long").alias("expected"), "at", "deadline", "answer", "kedge_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def serial_merge(callbacks: DataFrame, wait: int = 210, late: str = "10 minutes") -> DataFrame:
    """Each response's merge once, when its last callback is back or its time is over: ``response_id, outcome, returned, answer, edges,
    score, first_edge``, whatever the order of arrival within the watermark. Start it inside ``map_state``."""
    own = _within(callbacks, wait).withWatermark("at", late)
    return own.groupBy("response_id").transformWithStateInPandas(statefulProcessor=SerialMerge(wait), outputStructType=MERGED, outputMode="Append", timeMode="EventTime")


def batch_merge(callbacks: DataFrame, wait: int = 210) -> DataFrame:
    """The same of a whole table of callbacks, each once."""
    own = _within(callbacks, wait)
    counts = own.groupBy("response_id").agg(F.count_distinct("callback_id").alias("returned"), F.first("expected").alias("expected"))
    first = F.min_by("kedge_id", F.struct("at", "callback_id", "kedge_id"))
    merged = own.groupBy("response_id", "answer").agg(F.array_sort(F.collect_set("kedge_id")).alias("edges"), F.max("score").alias("score"), first.alias("first_edge"))
    outcome = F.when(F.col("returned") >= F.col("expected"), "complete").otherwise("timeout")
    return merged.join(counts, "response_id").select("response_id", outcome.alias("outcome"), "returned", "answer", "edges", "score", "first_edge")
