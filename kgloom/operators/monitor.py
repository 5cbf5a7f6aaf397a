"""Operational analytics over tasks, events, query states and heartbeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.functions.scalars import bucket_start
from kgloom.operators.checkpoints import kept

PERCENTILES = (50, 90, 95, 99)


def nearest_rank(sorted_values: Column, p: int) -> Column:
    """The element at ``round_half_even(p / 100 * (n - 1))``."""
    return F.element_at(sorted_values, F.bround(p / 100 * (F.size(sorted_values) - 1)).cast("int") + 1)


def latency_summary(tasks: DataFrame, seconds: int = 30) -> DataFrame:
    """Exact count, mean, percentiles, least and most of durations by stream and window.

    Values of equal duration are counted first, so a window's group holds distinct durations, not tasks.
    """
    own = tasks.withColumn("bucket", bucket_start(F.col("finished_at"), seconds))
    counted = own.groupBy("stream", "bucket", "duration_ms").agg(F.count("*").alias("k"))
    ahead = W.partitionBy("stream", "bucket").orderBy("duration_ms")
    ranked = counted.withColumn("upto", F.sum("k").over(ahead)).withColumn("n", F.sum("k").over(W.partitionBy("stream", "bucket")))

    def at(p: int) -> Column:
        return F.min(F.when(F.col("upto") > F.bround(p / 100 * (F.col("n") - 1)), F.col("duration_ms")))

    return ranked.groupBy("stream", "bucket").agg(F.sum("k").alias("count"), (F.sum(F.col("duration_ms") * F.col("k")) / F.sum("k")).alias("mean"), *(at(p).alias(f"p{p}") for p in PERCENTILES), F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"))


def bucketed_average(metrics: DataFrame, seconds: int) -> DataFrame:
    """``bucket, metric, value``: the mean of ``metric, ts, value`` rows."""
    return metrics.groupBy(bucket_start(F.col("ts"), seconds).alias("bucket"), "metric").agg(F.avg("value").alias("value"))


def bucketed_latency(summaries: DataFrame, seconds: int) -> DataFrame:
    """Summaries joined into longer buckets: counts add up, means and percentiles are averaged as they are."""
    means = [F.avg(c).alias(c) for c in ("mean", *(f"p{p}" for p in PERCENTILES))]
    return summaries.groupBy(bucket_start(F.col("bucket"), seconds).alias("bucket"), "stream").agg(F.sum("count").alias("count"), *means, F.min("min").alias("min"), F.max("max").alias("max"))


def transitions(states: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``alive`` differs from the worker's row before; a first row is none."""
    before = F.lag("alive").over(W.partitionBy(*keys).orderBy("ts", "event_id"))
    return states.withColumn("before", before).where("before is not null and before <> alive")


def _runs(rows: DataFrame, goes_on: Callable[[Callable[[str], Column]], Column], keys: tuple[str, ...]) -> DataFrame:
    """``keys, hit, began, ended, n, last_event`` of each run of ``keys, ts, event_id, hit`` rows that go on from the row before.

    Rows are dealt by ranges of key and time, and each range makes its own runs, so no task holds a hot key. The first and last run
    of a key in a range meet those of the ranges beside it in a table of two rows a key and range. ``goes_on`` gets a lookup of the
    columns before: ``ts`` and ``hit``.
    """
    dealt = kept(rows.select(*keys, "ts", "event_id", "hit").repartitionByRange(*keys, "ts", "event_id").withColumn("part", F.spark_partition_id()))
    order = W.partitionBy("part", *keys).orderBy("ts", "event_id")
    new = F.when(goes_on(lambda c: F.lag(c).over(order)), 0).otherwise(1)
    own = dealt.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = own.groupBy("part", *keys, "run").agg(F.first("hit").alias("hit"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    found = kept(found.withColumn("runs", F.max("run").over(W.partitionBy("part", *keys))))
    border = (F.col("run") == 1) | (F.col("run") == F.col("runs"))
    between = W.partitionBy(*keys).orderBy("part", "run")  # two rows a key and range
    before = {"ts": F.lag("ended").over(between), "hit": F.lag("hit").over(between)}
    ends = found.where(border).withColumn("ts", F.col("began"))
    ends = ends.withColumn("new", F.when((F.col("run") == 1) & goes_on(lambda c: before[c]), 0).otherwise(1)).withColumn("whole", F.sum("new").over(between.rowsBetween(W.unboundedPreceding, W.currentRow)))
    met = ends.groupBy(*keys, "whole").agg(F.first("hit").alias("hit"), F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n").alias("n"), F.max("last").alias("last")).drop("whole")
    columns = [*keys, "hit", "began", "ended", "n", "last"]
    return found.where(~border).select(*columns).union(met.select(*columns)).withColumn("last_event", F.col("last.event_id")).drop("last")


def streaks(samples: DataFrame, breached: Column, *keys: str) -> DataFrame:
    """``keys, began, ended, n`` of each run of rows that breach a rule in a row."""
    own = samples.withColumn("hit", F.coalesce(breached, F.lit(False)))
    return _runs(own, lambda before: before("hit") == F.col("hit"), keys).where("hit").select(*keys, "began", "ended", "n")


def sessions(events: DataFrame, gap_seconds: int, *keys: str) -> DataFrame:
    """Bursts: rows no further apart than a gap; the count and the last ``event_id`` of each."""
    gap = F.expr(f"interval {gap_seconds} seconds")
    return _runs(events.withColumn("hit", F.lit(True)), lambda before: F.col("ts") <= before("ts") + gap, keys).select(*keys, "began", "ended", "n", "last_event")


def utilization(backlog: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, backlog / capacity).otherwise(F.when(backlog > 0, 1.0).otherwise(0.0))


def purged(states: DataFrame, now: Column, days: int) -> DataFrame:
    """What a retention of ``days`` keeps: rows in flight, and terminal ones young enough; 0 keeps all."""
    if days == 0:
        return states
    return states.where(~F.col("state").isin("COMPLETED", "ABANDONED") | (F.col("start_time") >= now - F.expr(f"interval {days} days")))


def orphaned(pending: DataFrame, alive: DataFrame, floors: DataFrame, now: Column, default: int = 30) -> DataFrame:
    """Pending tasks of consumers without a heartbeat that are idle as long as their stream's floor."""
    idle = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("finished_at").cast("timestamp"))
    own = pending.join(alive, "consumer", "left_anti").join(F.broadcast(floors), "stream", "left")  # a row a stream
    return own.where(idle >= F.coalesce("floor", F.lit(default)))


def last_n(df: DataFrame, n: int, keys: list[str], *order: Column, parts: int = 64) -> DataFrame:
    """Each group's last ``n`` rows. A group's rows are dealt by their hash first and each part keeps its last ``n``, so one task sees at most
    ``n`` rows of each of ``parts`` parts."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    few = df.withColumn("_p", part).withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order))).where(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_p")


def snapshot(backlog: DataFrame, workers: DataFrame, used: DataFrame, capacity: float) -> DataFrame:
    """``stream, backlog, peak, workers, disk_used_pct, severity``: rollups by stream beside each other; a stream without workers is critical,
    an unknown capacity (0) gives 0 per cent."""
    share = F.round(100 * F.col("used") / capacity + 1e-9, 2) if capacity else F.lit(0.0)
    own = backlog.join(workers, "stream", "left").join(F.broadcast(used))  # one row
    alive = F.coalesce("workers", F.lit(0))
    return own.select("stream", "backlog", "peak", alive.alias("workers"), share.alias("disk_used_pct"), F.when(alive == 0, "critical").otherwise("info").alias("severity"))


def dashboard(events: DataFrame) -> DataFrame:
    """``stream, bucket, total, position, class``: hourly points of the streams with a value above 0, each with its stream's total, its place in the span
    in per cent (a span is a minute at least) and its class of load against the stream's highest point."""
    points = events.groupBy("stream", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"), F.max("value").alias("y"))
    whole = points.groupBy("stream").agg(F.sum("n").alias("total"), F.max("y").alias("top")).where("top > 0")
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    span = events.agg(F.min(second(F.col("ts"))).alias("since"), F.max(second(F.col("ts"))).alias("until"))
    own = points.join(whole, "stream").join(F.broadcast(span))  # one row
    at = (second(F.col("bucket")) - F.col("since")) / F.greatest(F.lit(60.0), F.col("until") - F.col("since")) * 100
    load = F.col("y") / F.col("top")
    return own.select("stream", "bucket", "total", at.alias("position"), F.when(load < 0.3, "low").when(load < 0.8, "busy").otherwise("full").alias("class"))
