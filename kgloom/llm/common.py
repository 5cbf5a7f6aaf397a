"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kgloom-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. A session without that setting gets one below its warehouse, or, where
    driver and executors are one process (tests), a temporary one.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or (_own_folder() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/kgloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: a cut of the lineage that survives lost executors."""
    path = f"{work_dir(df.sparkSession, label)}/{label}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at).getParent()
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null: empty) alone, so that extra columns cannot clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_texts(df: DataFrame, rows: Callable[[list, list[str]], dict], schema: str, setup: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``rows(doc_ids, texts) -> columns`` to each Arrow batch of an ``id_text`` frame."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = rows(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat ``name type, ...`` string."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ddl.split(", "))])
