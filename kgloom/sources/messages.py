"""Query messages as rows: JSON in Parquet with zstd, and their graphs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<name:string,categories:array<string>,attributes:array<struct<attribute_type_id:string,original_attribute_name:string,value:string>>>"
EDGE = "struct<subject:string,object:string,predicate:string,sources:array<struct<resource_id:string,resource_role:string>>,attributes:array<struct<attribute_type_id:string,original_attribute_name:string,value:string>>>"
RESULT = "struct<node_bindings:map<string,array<struct<id:string>>>,analyses:array<struct<score:double,edge_bindings:map<string,array<struct<id:string>>>,support_graphs:array<string>>>>"
MESSAGE = f"struct<message:struct<knowledge_graph:struct<nodes:map<string,{NODE}>,edges:map<string,{EDGE}>>,results:array<{RESULT}>,auxiliary_graphs:map<string,struct<edges:array<string>>>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``message_id, raw, body``: a JSON message a file; ``raw`` is the text as it is."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("message_id"), F.col("value").alias("raw"))
    return parsed(raw)


def parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("body", F.from_json("raw", MESSAGE))


def save(messages: DataFrame, path: str) -> None:
    messages.select("message_id", "raw").write.mode("overwrite").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.parquet(path))


def nodes(messages: DataFrame) -> DataFrame:
    own = messages.select("message_id", F.explode("body.message.knowledge_graph.nodes").alias("node_id", "n"))
    return own.select("message_id", "node_id", "n.name", "n.categories", "n.attributes")


def edges(messages: DataFrame) -> DataFrame:
    own = messages.select("message_id", F.explode("body.message.knowledge_graph.edges").alias("edge_id", "e"))
    return own.select("message_id", "edge_id", "e.subject", "e.object", "e.predicate", "e.sources", "e.attributes")


def analyses(messages: DataFrame) -> DataFrame:
    """``message_id, result_id, pos, score``; a missing score is 0."""
    own = messages.select("message_id", F.posexplode("body.message.results").alias("result_id", "r"))
    return own.select("message_id", "result_id", F.posexplode("r.analyses").alias("pos", "a")).select("message_id", "result_id", "pos", F.coalesce("a.score", F.lit(0.0)).alias("score"))


def node_bindings(messages: DataFrame) -> DataFrame:
    own = messages.select("message_id", F.posexplode("body.message.results").alias("result_id", "r"))
    own = own.select("message_id", "result_id", F.explode("r.node_bindings").alias("qnode", "b"))
    return own.select("message_id", "result_id", "qnode", F.explode("b").alias("k")).select("message_id", "result_id", "qnode", F.col("k.id").alias("knode"))


def supports(messages: DataFrame) -> DataFrame:
    """``message_id, edge_id, aux_id`` of edges that name support graphs."""
    own = edges(messages).select("message_id", "edge_id", F.explode("attributes").alias("a")).where("a.attribute_type_id = 'biolink:support_graphs'")
    ids = F.coalesce(F.from_json("a.value", "array<string>"), F.array("a.value"))
    return own.select("message_id", "edge_id", F.explode(ids).alias("aux_id"))


def aux_graphs(messages: DataFrame) -> DataFrame:
    own = messages.select("message_id", F.explode("body.message.auxiliary_graphs").alias("aux_id", "g"))
    return own.select("message_id", "aux_id", F.explode("g.edges").alias("edge_id"))
