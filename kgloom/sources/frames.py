"""Messages as zstd frames in a table: saved with a lifetime, the latest of an id counts, an id that isn't there is an error.

Frames lie in shards by a hash of their id, so that a lookup of a few ids reads a few shards. Each save is a folder of its own.
"""

from __future__ import annotations

import io

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

SHARDS = 64
_TABLE = "message_id string, frame binary, saved_at timestamp, expires_at timestamp, shard int"


@F.pandas_udf(BinaryType())
def encoded(raw: pd.Series) -> pd.Series:
    """A text as a zstd frame; null stays null."""
    to = zstandard.ZstdCompressor()
    return raw.map(lambda text: None if text is None else to.compress(text.encode()))


@F.pandas_udf(StructType([StructField("raw", StringType()), StructField("problem", StringType())]))
def _decoded(frames: pd.Series) -> pd.DataFrame:
    own = zstandard.ZstdDecompressor()
    rows = []
    for frame in frames:
        try:
            # read as a stream: frames need not say how long their content is
            text = None if frame is None else own.stream_reader(io.BytesIO(frame)).read()
            # a frame that is cut short gives what there is, so its end is asked for as well
            if frame is not None and not _whole(frame, len(text)):
                raise zstandard.ZstdError("the frame is cut short")
            rows.append((None if text is None else text.decode(), None))
        except (zstandard.ZstdError, UnicodeDecodeError) as found:
            rows.append((None, str(found)))
    return pd.DataFrame(rows, columns=["raw", "problem"])


def _whole(frame: bytes, length: int) -> bool:
    said = zstandard.frame_content_size(frame)
    if said >= 0:
        return said == length
    one = zstandard.ZstdDecompressor().decompressobj()
    one.decompress(frame)
    return one.eof


def decoded(frames: DataFrame, strict: bool = True) -> DataFrame:
    """``raw`` (and ``problem``) beside the columns of ``frames`` (``message_id, frame``): a frame that is damaged, cut short or no UTF-8 stops the
    job with the id of its message, or, if not ``strict``, has its reason in ``problem``. A null frame has a null text."""
    own = frames.withColumn("_d", _decoded("frame")).withColumns({"raw": F.col("_d.raw"), "problem": F.col("_d.problem")}).drop("_d", "frame")
    if not strict:
        return own
    stop = F.raise_error(F.concat(F.lit("frame of message "), F.coalesce("message_id", F.lit("null")), F.lit(": "), F.col("problem")))
    return own.withColumn("raw", F.when(F.col("problem").isNotNull(), stop.cast("string")).otherwise(F.col("raw"))).drop("problem")


def read_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``message_id, raw`` of files that are a frame each, named by their message."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.json)?(?:\.zst)?$", 1)
    return decoded(spark.read.format("binaryFile").load(path).select(name.alias("message_id"), F.col("content").alias("frame")), strict)


def _shard(message_id: Column) -> Column:
    return F.pmod(F.hash(message_id), F.lit(SHARDS))


def save(messages: DataFrame, path: str, now: Column, seconds: int) -> None:
    """Add ``message_id, raw`` to the table, to be read until ``seconds`` after ``now``. Rows without an id or text are not saved; of rows with the same id the
    greatest text counts, so that a task that runs twice saves the same."""
    own = messages.where("message_id is not null and raw is not null").groupBy("message_id").agg(F.max("raw").alias("raw"))
    at = now.cast("timestamp")
    rows = own.select("message_id", encoded("raw").alias("frame"), at.alias("saved_at"), F.timestamp_seconds(F.unix_micros(at) / 1e6 + seconds).alias("expires_at"), _shard(F.col("message_id")).alias("shard"))
    rows.write.mode("append").partitionBy("shard").option("compression", "none").parquet(path)


def _latest(rows: DataFrame, now: Column) -> DataFrame:
    alive = rows.where(F.col("expires_at") > now.cast("timestamp"))
    newest = alive.groupBy("message_id").agg(F.max("saved_at").alias("saved_at"))  # ids and times alone, no frames
    twice = alive.join(newest, ["message_id", "saved_at"])  # saved twice in one moment: the greatest frame, in any order of files
    return twice.groupBy("message_id").agg(F.max("frame").alias("frame"))


def load(spark: SparkSession, path: str, now: Column, strict: bool = True) -> DataFrame:
    """``message_id, raw`` of all messages whose time isn't over, each as it was saved last. A message that was saved again and whose later save is over is as
    its earlier one if that still lives."""
    return decoded(_latest(spark.read.schema(_TABLE).parquet(path), now), strict)


def get(spark: SparkSession, path: str, ids: list[str], now: Column) -> DataFrame:
    """``message_id, raw`` of these messages; one that isn't there, or whose time is over, stops the job with its id. Only their shards are read."""
    asked = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "message_id string")
    shards = [r[0] for r in asked.select(_shard(F.col("message_id"))).distinct().collect()]  # as many as SHARDS at most
    rows = spark.read.schema(_TABLE).parquet(path).where(F.col("shard").isin(shards) & F.col("message_id").isin(list(ids)))
    found = asked.join(decoded(_latest(rows, now)), "message_id", "left")
    missing = F.raise_error(F.concat(F.lit("no message "), F.col("message_id"))).cast("string")
    return found.select("message_id", F.when(F.col("raw").isNull(), missing).otherwise(F.col("raw")).alias("raw"))


def living(spark: SparkSession, path: str, now: Column, into: str) -> None:
    """All saves whose time isn't over, as a new table; the old one can then be deleted."""
    spark.read.schema(_TABLE).parquet(path).where(F.col("expires_at") > now.cast("timestamp")).write.partitionBy("shard").option("compression", "none").parquet(into)


def intake(queries: DataFrame, path: str, now: Column, seconds: int) -> DataFrame:
    """Save each query's text (``query_id, response_id, raw, callback_url, target``) under both of its ids; its row of state is given back. A query
    without an id or text has state ``ERROR`` and saves nothing."""
    good = F.col("query_id").isNotNull() & F.col("response_id").isNotNull() & F.col("raw").isNotNull()
    both = queries.where(good).select(F.explode(F.array("query_id", "response_id")).alias("message_id"), "raw")
    save(both, path, now, seconds)
    ok = F.when(good, "QUEUED").otherwise("ERROR")
    return queries.select("query_id", "response_id", "callback_url", "target", now.cast("timestamp").alias("start_time"), ok.alias("state"), F.when(good, "OK").otherwise("ERROR").alias("status"))
