"""Streaming operators: latency windows, duplicate callbacks, incremental merging, worker liveness, alerts and completion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgloom.operators.checkpoints import new_folder
from kgloom.operators.monitor import PERCENTILES

LIVENESS = "consumer string, ts timestamp, state string, event string"
ALERTS = "rule string, metric string, ts timestamp, value double"
BARRIER = "response_id long, ts timestamp, outcome string, returned long"


def latency_windows(tasks: DataFrame, seconds: int = 30, late: str = "1 minute", accuracy: int = 10_000) -> DataFrame:
    """Count, mean, percentiles, least and most of durations by stream and event-time window; windows close when the
    watermark passes. Percentiles are sketches, so that a window's state has a bounded size: their rank is off by at most
    1 / ``accuracy`` of the window's rows."""
    own = tasks.withColumn("at", F.col("finished_at").cast("timestamp")).withWatermark("at", late)
    sketch = F.percentile_approx("duration_ms", [p / 100 for p in PERCENTILES], accuracy).alias("at_p")
    found = own.groupBy(F.window("at", f"{seconds} seconds"), "stream").agg(F.count("*").alias("count"), F.avg("duration_ms").alias("mean"), sketch, F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"))
    return found.select(F.col("window.start").alias("bucket"), "stream", "count", "mean", *(F.get("at_p", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)), "min", "max")


def once(callbacks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each callback id once within the watermark, however often it is delivered."""
    return callbacks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["callback_id"])


def merged_answers(callbacks: DataFrame) -> DataFrame:
    """The running merge of callbacks by response and answer: distinct edges and the best score. Its state is a row a
    response and answer, and a set of that answer's edges."""
    return callbacks.groupBy("response_id", "answer").agg(F.array_sort(F.collect_set("kedge_id")).alias("edges"), F.max("score").alias("score"))


def _liveness(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """alive, scaled_down (it said so) or crashed (silent too long); an event whenever the state changes."""
    (consumer,) = key
    before = state.get[0] if state.exists else "unknown"
    rows = []
    if state.hasTimedOut:
        if before == "alive":
            rows.append((consumer, pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), "crashed", "crashed"))
            state.update(("crashed",))
    else:
        beats = pd.concat(list(batches)).sort_values("at")
        for at, stopping in zip(beats["at"], beats["stopping"], strict=True):
            now = "scaled_down" if stopping else "alive"
            if now != before:
                rows.append((consumer, at, now, "scale_down" if stopping else "scale_up"))
            before = now
        state.update((before,))
        if before == "alive":
            state.setTimeoutTimestamp(max(int(beats["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 15_000)
    yield pd.DataFrame(rows, columns=["consumer", "ts", "state", "event"])


def liveness(beats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """State changes of ``consumer`` from heartbeats ``consumer, ts, stopping``: silent for 15 s is crashed."""
    own = beats.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).select("consumer", "at", "stopping")
    return own.groupBy("consumer").applyInPandasWithState(_liveness, LIVENESS, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _alerts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rule, metric = key
    since, last = state.get if state.exists else (None, None)
    rows = []
    for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
        now = r.at.timestamp()
        if pd.isna(r.value) or not (r.value > r.threshold or (r.inclusive and r.value == r.threshold)):
            since = None
            continue
        since = now if since is None else since
        if now - since >= r.duration and (last is None or now - last >= r.cooldown):
            rows.append((rule, metric, r.at, r.value))
            last = now
    state.update((since, last))
    yield pd.DataFrame(rows, columns=["rule", "metric", "ts", "value"])


def alerts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule, metric, ts, value`` of each alert from samples ``metric, ts, value``.

    Rules (a configuration table) are ``rule, metric, threshold, inclusive, duration, cooldown``, in seconds. A rule fires once
    its metric has stayed above the threshold (or at it, if ``inclusive``) for ``duration``, then not again within ``cooldown``.
    A value below, or null, ends the streak; the cooldown goes on. Rows without metric, time or a rule fire nothing. State is two
    times a rule; a task sorts what one trigger brings of one metric.
    """
    own = samples.select("metric", F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value")).where("at is not null")
    held = rules.select("rule", "metric", F.col("threshold").cast("double").alias("threshold"), F.coalesce("inclusive", F.lit(False)).alias("inclusive"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("duration", "cooldown")))
    return own.join(held, "metric").groupBy("rule", "metric").applyInPandasWithState(_alerts, ALERTS, "since double, last double", "append", GroupStateTimeout.NoTimeout)


def _barrier(timeout: float, linger: float):  # noqa: ANN202
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (response,) = key
        first, awaited, back, done = state.get if state.exists else (None, None, 0, False)
        rows = []
        if state.hasTimedOut:
            if not done:
                rows.append((response, pd.Timestamp(first + timeout, unit="s"), "unknown" if awaited is None else "timeout", back))
            if done or linger <= 0:
                state.remove()
            else:
                state.update((first, awaited, back, True))
                state.setTimeoutTimestamp(max(int((first + timeout + linger) * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            for r in pd.concat(list(batches)).sort_values(["at", "kind"], ascending=[True, False], kind="stable").itertuples():
                now = r.at.timestamp()
                first = now if first is None else min(first, now)
                if r.kind == "sent":
                    awaited = (awaited or 0) + int(r.n)
                else:
                    back += 1
                if done or now > first + timeout:
                    if r.kind != "sent":
                        rows.append((response, r.at, "late", back))
                elif awaited is not None and back >= awaited:
                    rows.append((response, r.at, "complete", back))
                    done = True
            state.update((first, awaited, back, done))
            state.setTimeoutTimestamp(max(int((first + timeout + (linger if done else 0)) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["response_id", "ts", "outcome", "returned"])

    return step


def completion(events: DataFrame, timeout: float = 210, linger: float = 600, late: str = "10 seconds") -> DataFrame:
    """``response_id, ts, outcome, returned``: when all callbacks of a response are back, or its time is up.

    Events are ``response_id, ts, kind, n``: ``sent`` announces n callbacks, ``back`` is one of them (``once`` drops repeats). A
    response is ``complete`` with the last one, or at its first event's time + ``timeout`` a ``timeout`` with those that are back
    (``unknown`` if nothing was announced); a callback after that is ``late``. State is four values a response, and goes
    ``linger`` seconds after the end. Events without response or time count for none.
    """
    own = events.select(F.col("response_id").cast("long").alias("response_id"), F.col("ts").cast("timestamp").alias("at"), "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    own = own.where("response_id is not null and at is not null and kind in ('sent', 'back')").withWatermark("at", late)
    return own.groupBy("response_id").applyInPandasWithState(_barrier(timeout, linger), BARRIER, "first double, awaited long, back long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that an aggregating stream gives for what its source holds now, as a table in the shared folder. Each trigger replaces the
    table by the whole result, so a repeated trigger changes nothing."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/result")  # what a source without rows gives

    def replace(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/result")

    run = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/result")
