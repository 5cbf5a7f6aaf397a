"""Workers' lives from heartbeats, with timers that fire without a new row: consumers that fall silent, what that does to their
worker, and alerts about workers that are down, held back for a moment so that several become one.

Times in state and results are microseconds (``at``), so that order and gaps are exact. Rows wait until the watermark has passed them and
are then taken in order, so that results don't depend on the order of arrival within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kgloom.operators.checkpoints import kept

#: Groups of consumers that share one state and timer: a call of Python for each of them and trigger, not for each consumer.
SHARDS = 256
CHANGES = "worker string, consumer string, at long, change string"
ALERTS = "channel string, closed_at long, n int, workers string, message string"


class _InOrder(StatefulProcessor):
    """Rows wait in state for the watermark; ``advance`` gets those that it has passed, by time, and then the watermark itself."""

    row: tuple[str, ...]  # columns of a waiting row, ``at`` first
    waiting_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fresh = [tuple(getattr(r, c) for c in self.row) for batch in rows for r in batch.itertuples()]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        yield from self._go(key, [*map(tuple, held), *fresh], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._go(key, list(map(tuple, self.waiting.get())) if self.waiting.exists() else [], timerValues)

    def _go(self, key, rows: list[tuple], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        passed = max(timer_values.getCurrentWatermarkInMs(), 0) * 1000
        due, later = sorted(r for r in rows if r[0] < passed), [r for r in rows if r[0] >= passed]
        found = self.advance(key, due, passed)
        self.waiting.put(later) if later else self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        wake = [r[0] for r in later] + [t for t in [self.next_timer()] if t is not None]
        if wake:
            self.handle.registerTimer(max(min(wake), passed) // 1000 + 1)
        yield found

    def advance(self, key: tuple, due: list[tuple], passed: int) -> pd.DataFrame:
        raise NotImplementedError

    def next_timer(self) -> int | None:
        """When something happens if no row comes."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Consumers(_InOrder):
    """State of a shard of consumers: the last beat of each that is up, and beats that the watermark hasn't passed."""

    row, waiting_schema = ("at", "worker", "consumer", "stopping"), "at long, worker string, consumer string, stopping boolean"

    def __init__(self, silent: int):
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.up = handle.getListState("up", "worker string, consumer string, at long")

    def advance(self, key: tuple, due: list[tuple], passed: int) -> pd.DataFrame:
        names = ["at", "worker", "consumer", "stopping", "held"]
        held = [(r[2], r[0], r[1], False, True) for r in self.up.get()] if self.up.exists() else []
        if not held and not due:
            self._next = None
            return pd.DataFrame(columns=["worker", "consumer", "at", "change"])
        rows = pd.DataFrame([*held, *((*r, False) for r in due)], columns=names).astype({"at": "int64", "stopping": bool, "held": bool})
        rows = rows.assign(fresh=~rows["held"]).sort_values(["worker", "consumer", "at", "fresh", "stopping"], ignore_index=True)
        own = rows.groupby(["worker", "consumer"], sort=False)
        first, last = own.cumcount() == 0, own.cumcount(ascending=False) == 0
        gap = rows["at"].diff().fillna(0)
        broken = gap > self.silent
        # the row before, if it is of the same consumer, is a beat that was up until this one or until it fell silent
        beaten = ~first & ~rows["stopping"].shift(fill_value=False)
        beats, ended = rows[~rows["stopping"]], last & ~rows["stopping"]
        up = rows[rows["fresh"] & ~rows["stopping"] & (~beaten | broken)].assign(change="up")
        stopped = rows[rows["stopping"] & beaten & ~broken].assign(change="stopped")
        over = (broken & ~first).shift(-1, fill_value=False) & ~last | ended & (rows["at"] + self.silent < passed)
        silent = beats[over[beats.index]]
        silent = silent.assign(at=silent["at"] + self.silent, change="silent")
        left = rows.loc[ended & ~over, ["worker", "consumer", "at"]]
        self._next = None if left.empty else int(left["at"].min()) + self.silent
        if len(left):
            self.up.put([(w, c, int(at)) for w, c, at in left.itertuples(index=False)])
        elif held:
            self.up.clear()
        return pd.concat([up, stopped, silent])[["worker", "consumer", "at", "change"]]

    def next_timer(self) -> int | None:
        return self._next


def consumer_changes(beats: DataFrame, silent: float = 15, late: str = "10 seconds") -> DataFrame:
    """``worker, consumer, at, change`` from heartbeats ``worker, consumer, ts, stopping``: ``up`` with a first beat, ``stopped`` with a beat that
    says so, ``silent`` once no beat has come for ``silent`` seconds, by a timer. A stop of a consumer that isn't up is nothing; null
    ``stopping`` is false; rows without worker, consumer or time are no beats; repeated beats change nothing; of beats at the same time
    a stop comes last. Consumers are taken a shard at a time, ``SHARDS`` of them for any number of consumers; state is a time a consumer that is
    up and the beats within the watermark, and a trigger rewrites what the shards that it touches hold. Start it inside ``merging.map_state``.
    """
    own = beats.select(F.col("worker").cast("string").alias("worker"), F.col("consumer").cast("string").alias("consumer"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("stopping", F.lit(False)).alias("stopping"))
    own = own.dropna(subset=["worker", "consumer", "ts"]).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    own = own.withColumn("shard", F.pmod(F.xxhash64("worker", "consumer"), F.lit(SHARDS)).cast("int"))
    return own.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Consumers(int(silent * 1e6)), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def worker_states(changes: DataFrame, marker: float = 120) -> DataFrame:
    """``worker, at, consumer, type, from, to, state, recovered_from``: what each change does to its worker.

    A worker without consumers is ``scaled_down`` if one of them stopped at most ``marker`` seconds before, else ``crashed``; it stays so until one is
    up again. ``recovered_from`` is set where it comes back: that state, or ``unknown`` for its first consumer. Of changes at one time ups
    come first, then stops, then silences, then by consumer. Rows are dealt by ranges of worker and time and ranges meet by their
    totals, so that no task holds a hot worker.
    """
    turn = F.when(F.col("change") == "up", 0).when(F.col("change") == "stopped", 1).otherwise(2)
    order = ["worker", "at", "turn", "consumer"]
    own = changes.withColumn("turn", turn).withColumn("step", F.when(F.col("change") == "up", 1).otherwise(-1)).withColumn("stop", F.when(F.col("change") == "stopped", F.col("at")))
    dealt = kept(own.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = W.partitionBy("part", "worker").orderBy(*order[1:])
    upto = ahead.rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = dealt.select(*order, "part", "step", F.sum("step").over(upto).alias("n"), F.max("stop").over(upto).alias("stopped"), F.lag("at").over(ahead).alias("previous"))
    earlier = W.partitionBy("worker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a worker and range
    totals = dealt.groupBy("part", "worker").agg(F.sum("step").alias("n"), F.max("stop").alias("stopped"), F.max("at").alias("previous"))
    totals = totals.select("part", "worker", *(f(c).over(earlier).alias(f"{c}_before") for f, c in ((F.sum, "n"), (F.max, "stopped"), (F.max, "previous"))))
    met = inside.join(totals, ["part", "worker"])
    to = F.col("n") + F.coalesce("n_before", F.lit(0))
    stopped, previous = F.greatest("stopped", "stopped_before"), F.coalesce("previous", "previous_before")

    def ended(at: Column) -> Column:
        return F.when(at - stopped <= int(marker * 1e6), "scaled_down").otherwise("crashed")

    back = F.when((F.col("step") == 1) & (to == 1), F.when(previous.isNull(), "unknown").otherwise(ended(previous)))
    return met.select("worker", "at", "consumer", F.when(F.col("step") == 1, "scale_up").otherwise("scale_down").alias("type"), (to - F.col("step")).alias("from"), to.alias("to"), F.when(to > 0, "alive").otherwise(ended(F.col("at"))).alias("state"), back.alias("recovered_from"))


class _Down(_InOrder):
    """State of a channel: when each worker was last reported a kind of end, and the buffer of those not sent yet."""

    row, waiting_schema = ("at", "worker", "kind"), "at long, worker string, kind string"

    def __init__(self, cooldown: int, debounce: int):
        self.cooldown, self.debounce = cooldown, debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.reported = handle.getMapState("reported", "worker string, kind string", "at long")
        self.buffer = handle.getMapState("buffer", "worker string", "kind string, since long")

    def advance(self, key: tuple, due: list[tuple], passed: int) -> pd.DataFrame:
        held = {k[0]: (v[0], v[1]) for k, v in self.buffer.iterator()}
        known = {tuple(k): v[0] for k, v in self.reported.iterator()}  # read once, and what changes is written once
        before = dict(known)
        since = min((s for _, s in held.values()), default=None)
        out = []

        def close() -> None:
            names = sorted(held)
            only = "stopped without a word" if held[names[0]][0] == "crashed" else "was scaled to nothing"
            text = f"{names[0]} {only}" if len(names) == 1 else f"{len(names)} workers are down"
            out.append((*key, since + self.debounce, len(names), ",".join(f"{n}:{held[n][0]}" for n in names), text))
            held.clear()

        for at, worker, kind in due:
            if (worker, kind) in known and at - known[worker, kind] < self.cooldown:
                continue
            known[worker, kind] = at
            if held and at - since > self.debounce:
                close()
            since = since if held else at
            held[worker] = (kind, since)
        if held and since + self.debounce < passed:
            close()
        self.buffer.clear()
        for worker, (kind, _) in held.items():
            self.buffer.updateValue((worker,), (kind, since))
        for name, at in known.items():
            if at + self.cooldown >= passed:
                if before.get(name) != at:
                    self.reported.updateValue(name, (at,))
            elif name in before:
                self.reported.removeKey(name)
        self._closes = since + self.debounce if held else None
        return pd.DataFrame(out, columns=["channel", "closed_at", "n", "workers", "message"])

    def next_timer(self) -> int | None:
        return self._closes


def down_alerts(ends: DataFrame, boot: Column | None = None, grace: float = 60, cooldown: float = 600, debounce: float = 5, late: str = "10 seconds") -> DataFrame:
    """``channel, closed_at, n, workers, message``: alerts about ends ``channel, worker, ts, kind`` of workers (``crashed`` or ``scaled_down``).

    An end within ``grace`` seconds of ``boot`` is passed over, and so is a worker's end of the same kind within ``cooldown`` of the one last
    reported. The others of a channel go into a buffer that closes ``debounce`` seconds after its first, by a timer; a worker is
    in it once, with its last kind. Rows without channel, worker, time or kind are none. A channel's ends of one trigger are taken in one task:
    channels are to be as small as a group of people who are called. Start it inside ``merging.map_state``.
    """
    own = ends.select(F.col("channel").cast("string").alias("channel"), F.col("worker").cast("string").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "kind").dropna()
    if boot is not None:
        own = own.where(F.unix_micros("ts") >= F.unix_micros(boot) + int(grace * 1e6))
    own = own.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return own.groupBy("channel").transformWithStateInPandas(statefulProcessor=_Down(int(cooldown * 1e6), int(debounce * 1e6)), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")
