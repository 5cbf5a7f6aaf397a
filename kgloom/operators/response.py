"""Responses as tables: full merge of answers, result graphs and their probes, state, logs and edge flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_supported(attributes: Column) -> Column:
    """Whether an edge's attributes (``name, value``) name support graphs."""
    return F.exists(attributes, lambda a: a["name"] == "biolink:support_graphs")


def manual_override(attributes: Column, confidence: Column) -> Column:
    """A manual agent's edge has a confidence of 0.9."""
    manual = F.exists(attributes, lambda a: (a["name"] == "biolink:agent_type") & (a["value"] == "manual_agent"))
    return F.when(manual, 0.9).otherwise(confidence)


def completed(states: DataFrame, done: DataFrame) -> DataFrame:
    """``states`` after the queries of ``done`` (``qid, stop_time``) end: queued ones are completed and get their time, others stay."""
    ended = F.col("d.qid").isNotNull() & (F.col("state") == "QUEUED")
    joined = states.alias("s").join(done.alias("d"), F.col("s.qid") == F.col("d.qid"), "left")
    rest = [F.col(f"s.{c}") for c in states.columns if c != "state"]
    return joined.select(*rest, F.when(ended, "COMPLETED").otherwise(F.col("state")).alias("state"), F.when(ended, F.col("d.stop_time")).alias("stop_time"))


def logs(entries: DataFrame, key: str) -> DataFrame:
    """``key, log``: each key's entries (``ts, event_id, entry``), oldest first. A log is a column of one row, as its reader takes it whole."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "entry")))
    return entries.groupBy(key).agg(F.transform(ordered, lambda x: x["entry"]).alias("log"))


def merged_answers(analyses: DataFrame, predicate: str) -> DataFrame:
    """A row for each answer ``on_``: the nodes bound to the other query node in order of first appearance, creative results first; a support
    graph for each creative result, of its edges; one synthetic edge that they support, if there are any; the edges of
    lookup results. Rows are ``on_, result_id, pos, sn, kedge_id, creative``; scores don't survive a merge.

    Nodes and edges are made distinct before they are gathered, so an answer's row grows with what is different in it.
    """
    tag = F.when(F.col("creative"), 0).otherwise(1)
    first = analyses.groupBy("on_", "sn").agg(F.min(F.struct(tag.alias("tag"), "result_id")).alias("at"))
    nodes = first.groupBy("on_").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sn"))), lambda x: x["sn"]).alias("nodes"))
    aux = analyses.where("creative").select("on_", F.concat(F.lit("AUX:"), F.col("result_id").cast("string")).alias("aux_id")).distinct()
    aux = aux.groupBy("on_").agg(F.array_sort(F.collect_list("aux_id")).alias("aux_ids"))
    looked_up = analyses.where("not creative").select("on_", "kedge_id").distinct().groupBy("on_").agg(F.array_sort(F.collect_list("kedge_id")).alias("lookup_edges"))
    none = F.array().cast("array<string>")
    joined = nodes.join(aux, "on_", "left").join(looked_up, "on_", "left")
    edge = F.when(F.col("aux_ids").isNotNull(), F.concat(F.lit(f"{predicate}|"), F.col("on_")))
    return joined.select(F.col("on_").alias("answer"), "nodes", F.coalesce("aux_ids", none).alias("aux_ids"), F.coalesce("lookup_edges", none).alias("lookup_edges"), edge.alias("synthetic_edge"))


def support_graphs(analyses: DataFrame) -> DataFrame:
    """``aux_id, edges`` of creative results."""
    own = analyses.where("creative").select(F.concat(F.lit("AUX:"), F.col("result_id").cast("string")).alias("aux_id"), "kedge_id")
    return own.groupBy("aux_id").agg(F.array_sort(F.collect_set("kedge_id")).alias("edges"))


def result_graph(edge_bindings: DataFrame, node_bindings: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``result_id, pos, subject_q, object_q, kedge_id``: each bound edge between all query nodes that bind its ends in that result. Joins
    are made in ``parts`` partitions; a caller counts them, so that a task's memory doesn't grow with the tables."""
    by = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    ends = by(edges.select(F.col("edge_id").alias("kedge_id"), "subject", "object"), "kedge_id")
    bound = node_bindings.select("result_id", "qnode", "knode")
    s, o = (by(bound.toDF("result_id", f"{end}_q", end), "result_id", end).distinct() for end in ("subject", "object"))
    met = by(by(edge_bindings, "kedge_id").join(ends, "kedge_id"), "result_id", "subject").join(s, ["result_id", "subject"])
    met = by(met.select("result_id", "pos", "kedge_id", "subject_q", "object"), "result_id", "object").join(o, ["result_id", "object"])
    return by(met.select("result_id", "pos", "subject_q", "object_q", "kedge_id"), "result_id", "kedge_id").distinct()


def probes(edges: DataFrame, key: str = "result_id") -> DataFrame:
    """``key, node, degree``: each graph's nodes of lowest degree, by as many degrees as give two nodes. ``edges``: key, u, v; equal directed
    pairs count once. A graph is as small as its query."""
    degree = edges.select(key, "u", "v").distinct().select(key, F.explode(F.array("u", "v")).alias("node")).groupBy(key, "node").agg(F.count("*").alias("degree"))
    upto = F.count("*").over(W.partitionBy(key).orderBy("degree"))  # peers of one degree count together
    below = degree.withColumn("upto", upto).withColumn("peers", F.count("*").over(W.partitionBy(key, "degree")))
    return below.where(F.col("upto") - F.col("peers") <= 1).select(key, "node", "degree")
