"""Tables that take batches by key, once each: an insert that leaves rows alone that are there, safe when a batch comes again.

A table is a folder with a folder a day and, below it, one a batch (``day=2024-01-31/batch=7``). A batch is written over its own
folders only, so what a failed or repeated write leaves is replaced by the same rows, and no file of another batch is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType


class KeyedTable:
    """``columns`` is a DDL schema; ``keys`` name a row; ``at`` is the time, one of the keys, whose day is the folder.

    Rows without a key, or without the values that ``required`` lists, are not taken. Of a batch's rows with the same key the least by ``first``
    is taken (by the other columns in order if none are given), and rows of an earlier batch win over a later one's. A day of a batch is at most ``files`` files,
    dealt by the key, so that a day with most of the rows is still written by many tasks.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], at: str, required: tuple[str, ...] = (), first: tuple[str, ...] = (), files: int = 8):
        if at not in keys:
            raise ValueError(f"{at} is no key: rows of one key could stand in two days")
        self.spark, self.path, self.keys, self.at, self.required, self.files = spark, path, keys, at, required, files
        self.schema = spark.createDataFrame([], columns).schema
        self.names = self.schema.names
        self.first = first or tuple(n for n in self.names if n not in keys)

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return None
        placed = StructType([*self.schema.fields, StructField("day", DateType()), StructField("batch", LongType())])
        return spark.read.schema(placed).parquet(self.path)

    def read(self) -> DataFrame:
        """All stored rows."""
        there = self._stored(self.spark)
        return self.spark.createDataFrame([], self.schema) if there is None else there.select(*self.names)

    def days(self, since: Column, until: Column) -> DataFrame:
        """Stored rows from ``since`` to before ``until``; no other day's files are read."""
        there = self._stored(self.spark)
        if there is None:
            return self.read()
        inside = F.col("day").between(since.cast("date"), until.cast("date")) & (F.col(self.at) >= since) & (F.col(self.at) < until)
        return there.where(inside).select(*self.names)

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Take ``rows`` as batch ``batch``; the same again changes nothing, whatever came between.

        Only days from the batch's first to its last are read. A batch is compared with those of lower numbers, which were there when it first
        came, so batches are numbered from 0 as they come, by one writer.
        """
        own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).dropna(subset=[*self.keys, *self.required])
        rest = [n for n in self.names if n not in self.keys]
        if rest:  # one row a key, found map-side first
            least = F.min_by(F.struct(*rest), F.struct(*self.first)).alias("_row")
            own = own.groupBy(*self.keys).agg(least).select(*self.keys, "_row.*").select(*self.names)
        else:
            own = own.distinct()
        own = own.withColumn("day", F.col(self.at).cast("date"))
        there = self._stored(rows.sparkSession)
        if there is not None:
            span = rows.select(F.col(self.at).cast(self.schema[self.at].dataType).cast("date").alias("day")).agg(F.min("day"), F.max("day")).first()  # one row
            if span[0] is None:
                return
            held = there.where(F.col("day").between(*span) & (F.col("batch") < batch)).select("day", *self.keys)
            own = own.join(held, ["day", *self.keys], "left_anti")
        dealt = own.withColumn("batch", F.lit(batch).cast("long")).repartition("day", F.pmod(F.hash(*self.keys), F.lit(self.files)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day", "batch").parquet(self.path)

    def fed_by(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """A query that inserts each trigger's rows under the trigger's number; a trigger that is run again after a failure repeats its batch."""
        return stream.writeStream.foreachBatch(self.insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
