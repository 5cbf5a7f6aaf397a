"""Paths between two nodes: chains of three edges, their text, merged path sets, and answers to sets of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import kept

#: Neighbours of the source that are looked up by broadcast, some 50 MB; beyond them both sides are shuffled.
FEW = 1_000_000


def builder(source: str, target: str, predicates: list[str] | None = None, category: str | None = None) -> dict:
    """The query graph of three edges between two different pinned ids; the nodes between may have one category."""
    if not source or not target or source == target:
        raise ValueError("a path needs two different ends")
    own = {"categories": [category]} if category else {}
    step = {"predicates": predicates} if predicates else {}
    nodes = {"source": {"ids": [source]}, "first": dict(own), "second": dict(own), "target": {"ids": [target]}}
    names = list(nodes)
    return {"nodes": nodes, "edges": {f"step{k}": {"subject": a, "object": b, **step} for k, (a, b) in enumerate(zip(names, names[1:], strict=False))}}


def steps(edges: DataFrame) -> DataFrame:
    """``a, b, says``: pairs of nodes in both directions with the sorted predicates of all edges between them; an edge against its direction
    is an inverse."""
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b"), "predicate").union(edges.select("object", "subject", F.concat("predicate", F.lit(" (inverse)"))))
    return both.groupBy("a", "b").agg(F.concat_ws(" or ", F.array_sort(F.collect_set("predicate"))).alias("says"))


def linearized(edges: DataFrame, nodes: DataFrame, source: str, target: str) -> DataFrame:
    """``n1, n2, text`` of every path of exactly four different nodes from ``source`` to ``target``, in either direction of the edges. The pinned ends
    prune the first and the last step, so the middle one alone meets whole edges, in one pass that shuffles none of them while the source has no
    more than ``FEW`` neighbours."""
    one = lambda df, *names: steps(df).toDF(*names)
    at = lambda x: (F.col("subject") == x) | (F.col("object") == x)
    first = kept(one(edges.where(at(source)), "n0", "n1", "p1").where(F.col("n0") == source))
    last = one(edges.where(at(target)), "n2", "n3", "p3").where(F.col("n3") == target)
    near, ends = first.select("n1"), edges.select("subject", "object", "predicate")
    small = near.count() <= FEW
    for end in ("subject", "object"):
        marks = near.select(F.col("n1").alias(end), F.lit(True).alias(f"{end}_near"))
        ends = ends.join(F.broadcast(marks) if small else marks, end, "left")
    middle = ends.where("subject_near or object_near")
    out = one(middle.select("subject", "object", "predicate").distinct(), "n1", "n2", "p2").join(first, "n1").join(last, "n2")
    out = out.where((F.col("n1") != F.col("n2")) & ~F.col("n1").isin(source, target) & ~F.col("n2").isin(source, target))
    for k in range(4):
        out = out.join(nodes.select(F.col("node_id").alias(f"n{k}"), F.col("name").alias(f"name{k}")), f"n{k}")
    parts = ["name0", *(x for k in (1, 2, 3) for x in (F.lit(" -"), f"p{k}", F.lit("-> "), f"name{k}"))]
    return out.select("n1", "n2", F.concat(*parts).alias("text"))


def merged(analyses: DataFrame) -> DataFrame:
    """``aux_id, n, score, rank``: results with one edge set are one path; how many had it, its best score, and its rank."""
    own = analyses.groupBy("result_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("kedge_id"))).alias("edges"), F.max("score").alias("score"))
    paths = own.groupBy(F.concat(F.lit("PATH:"), F.md5("edges")).alias("aux_id")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
    return ranked(paths, F.desc("score"), "aux_id")


def ranked(df: DataFrame, *order: F.Column | str) -> DataFrame:
    """``df`` with ``rank`` in the order: sorted by range, each range adds the counts of those before it."""
    from pyspark.sql import Window as W

    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    ahead = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(ahead), "_part").withColumn("rank", F.col("_ahead") + own).drop("_part", "_ahead")


def set_answers(edges: DataFrame, least: float) -> DataFrame:
    """``node_id, n_edges, score``: nodes that a set of inputs leads to, by their share of all publications, from a least share on; each gets
    a synthetic edge for each input."""
    own = edges.groupBy(F.col("subject").alias("node_id")).agg(F.count_distinct("object").alias("n_edges"), F.sum("num_publications").alias("w"))
    total = own.agg(F.sum("w").alias("total"))
    return own.join(F.broadcast(total)).select("node_id", "n_edges", (F.col("w") / F.col("total")).alias("score")).where(F.col("score") >= least)  # one row
