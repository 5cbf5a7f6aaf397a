"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it names none (tests), a folder below the
    warehouse, or a temporary one if driver and executors are one process."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        own = "file://" + tempfile.mkdtemp(prefix="kgloom-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of lineage whose files ``drop`` deletes when no later step reads them."""
    path = f"{new_folder(df.sparkSession, name)}/{name}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``step`` wrote; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "written_at", None):
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
