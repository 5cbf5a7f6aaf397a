"""Queries of the stores: batches taken once by key, messages as frames with a lifetime, intake of queries under two ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import checkpoints
from kgloom.pipeline_queries import _stream
from kgloom.queries import query
from kgloom.sources import frames, star
from kgloom.sources.stored import KeyedTable


def _points(events: DataFrame, unit: str, times: int) -> DataFrame:
    return events.select(F.col("event_type").alias("metric"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"), (F.col("value") * times).alias("value"))


@query("""with m as (select event_type as metric, date_trunc('minute', ts) as ts, min(value) as value from events where event_type is not null and ts is not null and value is not null group by 1, 2),
 h as (select event_type as metric, date_trunc('hour', ts) as ts, min(value * 2) as value from events where event_type is not null and ts is not null and value is not null group by 1, 2)
 select metric, cast(ts as timestamp) as ts, value from m union all select metric, cast(ts as timestamp), value from h where not exists (select 1 from m where m.metric = h.metric and m.ts = h.ts)""")
def q146_idempotent_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Points by minute from a stream, then points by hour, which give way to those that are there; then both batches once more."""
    folder = checkpoints.new_folder(spark, "metrics")
    held = KeyedTable(spark, f"{folder}/table", "metric string, ts timestamp_ntz, value double", ["metric", "ts"], "ts", required=("value",))
    held.fed_by(_points(_stream(spark, sf, "events"), "minute", 1), f"{folder}/progress").awaitTermination()
    events = star.table(spark, sf, "events")
    for batch, (unit, times) in ((1, ("hour", 2)), (0, ("minute", 1)), (1, ("hour", 2))):
        held.insert(_points(events, unit, times), batch)
    return held.read()


def _moment(seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))


@query("select 'ORDER:' || o_orderkey as message_id, o_custkey as customer, o_totalprice + case when o_orderstatus = 'F' then 1 else 0 end as price from orders where o_orderstatus <> 'P'")
def q147_message_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A message an order: pending ones' time is over when all are read, finished ones were saved again with another price."""
    orders, path = star.table(spark, sf, "orders"), checkpoints.new_folder(spark, "frames")

    def saved(rows: DataFrame, more: int, at: int, seconds: int) -> None:
        body = F.to_json(F.struct(F.col("o_custkey").alias("customer"), (F.col("o_totalprice") + more).alias("price")))
        frames.save(rows.select(F.concat(F.lit("ORDER:"), F.col("o_orderkey").cast("string")).alias("message_id"), body.alias("raw")), path, _moment(at), seconds)

    saved(orders.where("o_orderstatus <> 'P'"), 0, 0, 3600)
    saved(orders.where("o_orderstatus = 'P'"), 0, 0, 5)
    saved(orders.where("o_orderstatus = 'F'"), 1, 10, 3600)
    read = frames.load(spark, path, _moment(60)).withColumn("body", F.from_json("raw", "customer long, price double"))
    return read.select("message_id", "body.customer", "body.price")


@query("""select 'Q' || o_orderkey as query_id, 'R' || o_orderkey as response_id, o_orderstatus as target, case when o_orderpriority = '5-LOW' then 'ERROR' else 'QUEUED' end as state,
 case when o_orderpriority = '5-LOW' then 'ERROR' else 'OK' end as status, cast(case when o_orderpriority = '5-LOW' then 0 else 2 end as bigint) as n_saved from orders""")
def q148_intake(spark: SparkSession, sf: str) -> DataFrame:
    """A query an order; those without a text are errors. What is saved is read again and must be the query's text under both ids."""
    o = star.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderpriority") != "5-LOW", F.to_json(F.struct(F.lit("lookup").alias("kind"), "o_custkey", "o_orderpriority")))
    asked = o.select(F.concat(F.lit("Q"), key).alias("query_id"), F.concat(F.lit("R"), key).alias("response_id"), raw.alias("raw"), F.lit(None).cast("string").alias("callback_url"), F.col("o_orderstatus").alias("target"))
    path = checkpoints.new_folder(spark, "intake")
    states = frames.intake(asked, path, _moment(0), 3600)
    there = frames.load(spark, path, _moment(1))
    ids = asked.select("query_id", "raw", F.explode(F.array("query_id", "response_id")).alias("message_id"))
    counts = ids.join(there.withColumnRenamed("raw", "found"), "message_id").where("raw = found").groupBy("query_id").agg(F.count("*").alias("n"))
    return states.join(counts, "query_id", "left").select("query_id", "response_id", "target", "state", "status", F.coalesce("n", F.lit(0)).alias("n_saved"))
