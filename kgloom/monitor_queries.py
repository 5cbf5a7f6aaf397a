"""Queries of the monitor's streams: consumers that fall silent, what that does to their workers, alerts held back until a buffer closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import checkpoints
from kgloom.pipeline_queries import _stream
from kgloom.queries import query
from kgloom.streaming import merging, workers

# A worker for each user with a consumer for each kind of event; a value above 30 says that the consumer stops. Half a day without a beat is silence.
_HALF_DAY = 43_200
_FAR = 4_000_000_000


def _with_ticks(spark: SparkSession, sf: str, rows: DataFrame, **marked: Column) -> DataFrame:
    """The stream and, for each region, a row far ahead under a name of its own, so that the last timers fire."""
    ticks = _stream(spark, sf, "region").select(*(marked[c].cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return rows.union(ticks)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    own = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("worker"), F.col("event_type").alias("consumer"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 30).alias("stopping"))
    beats = _with_ticks(spark, sf, own, worker=F.concat(F.lit("tick"), "r_regionkey"), consumer=F.lit("tick"), ts=F.timestamp_seconds(F.lit(_FAR)), stopping=F.lit(False))
    return merging.gathered(workers.consumer_changes(beats, _HALF_DAY), "changes")


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


_CHANGES = f"""b as (select cast(user_id as varchar) as worker, event_type as consumer, epoch_us(ts) as mt, coalesce(value > 30, false) as stop from events where user_id is not null and event_type is not null and ts is not null),
 g as (select *, lag(mt) over w as p, lag(stop) over w as ps, lead(mt) over w as nx from b window w as (partition by worker, consumer order by mt, stop)),
 changes as (select worker, consumer, mt, 'up' as change from g where not stop and (p is null or ps or mt - p > {_HALF_DAY}000000)
 union all select worker, consumer, mt, 'stopped' from g where stop and not ps and mt - p <= {_HALF_DAY}000000
 union all select worker, consumer, mt + {_HALF_DAY}000000, 'silent' from g where not stop and (nx is null or nx - mt > {_HALF_DAY}000000))"""


@query(f'with {_CHANGES} select worker, consumer, make_timestamp(mt) as "at", change from changes')
def q143_consumer_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).withColumn("at", _time(F.col("at")))


_STATES = _CHANGES + """, o as (select *, case change when 'up' then 1 else -1 end as step, case change when 'up' then 0 when 'stopped' then 1 else 2 end as turn from changes),
 s as (select *, sum(step) over w as n, max(mt) filter (change = 'stopped') over w as stopped, lag(mt) over w as p from o window w as (partition by worker order by mt, turn, consumer)),
 states as (select worker, mt, consumer, case step when 1 then 'scale_up' else 'scale_down' end as type, n - step as "from", n as "to",
 case when n > 0 then 'alive' when mt - stopped <= 3600000000 then 'scaled_down' else 'crashed' end as state,
 case when step = 1 and n = 1 then case when p is null then 'unknown' when p - stopped <= 3600000000 then 'scaled_down' else 'crashed' end end as recovered_from from s)"""


@query(f'with {_STATES} select worker, make_timestamp(mt) as "at", consumer, type, cast("from" as bigint) as "from", cast("to" as bigint) as "to", state, recovered_from from states')
def q144_worker_states(spark: SparkSession, sf: str) -> DataFrame:
    """Crashed and scaled-down workers with the counts around each change, a stop within the last hour as a marker."""
    return workers.worker_states(_changes(spark, sf), 3600).withColumn("at", _time(F.col("at")))


@query(f"""with recursive {_STATES},
 e as (select cast(worker as bigint) // 20 as channel, worker, state as kind, mt from states where "to" = 0 and mt >= epoch_us(timestamp '2024-01-02')),
 r as (select channel, worker, kind, min(mt) as mt from e group by 1, 2, 3
 union all select r.channel, r.worker, r.kind, min(e.mt) from r join e on e.worker = r.worker and e.kind = r.kind and e.mt >= r.mt + 432000000000 group by r.channel, r.worker, r.kind, r.mt),
 f as (select channel, min(mt) as since from r group by 1 union all select f.channel, min(r2.mt) from f join (select channel, mt from r) r2 on r2.channel = f.channel and r2.mt > f.since + 21600000000 group by f.channel, f.since),
 h as (select f.channel, f.since, r.worker, arg_max(r.kind, (r.mt, r.kind)) as kind from f join r on r.channel = f.channel and r.mt between f.since and f.since + 21600000000 group by 1, 2, 3)
 select cast(channel as varchar) as channel, make_timestamp(since + 21600000000) as closed_at, count(*) as n, string_agg(worker || ':' || kind, ',' order by worker) as workers from h group by channel, since""")
def q145_down_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Workers without consumers, twenty workers a channel: none in the first day, one of a kind in five days, what follows within six hours in one alert."""
    ends = workers.worker_states(_changes(spark, sf), 3600).where("to = 0").select(F.expr("cast(worker as bigint) div 20").cast("string").alias("channel"), "worker", F.timestamp_micros("at").alias("ts"), F.col("state").alias("kind"))
    stored = checkpoints.step(ends, "ends")
    stream = spark.readStream.schema(stored.schema).parquet(stored.written_at)
    fed = _with_ticks(spark, sf, stream, channel=F.concat(F.lit("tick"), "r_regionkey"), worker=F.lit("tick"), ts=F.timestamp_seconds(F.lit(_FAR)), kind=F.lit("crashed"))
    start = F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp")
    found = merging.gathered(workers.down_alerts(fed, start, grace=86_400, cooldown=432_000, debounce=21_600), "alerts")
    checkpoints.drop(stored)
    return found.select("channel", _time(F.col("closed_at")).alias("closed_at"), F.col("n").cast("long").alias("n"), "workers")
