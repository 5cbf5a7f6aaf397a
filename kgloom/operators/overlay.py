"""Co-occurrence overlay: node counts, pairs, shared counts and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.scoring import cooccurrence

MOST_PAIRS = 1_000_000


def pairs(members: DataFrame) -> DataFrame:
    """``a, b, shared``: node pairs of the same result and how many results they share. A result binds as many nodes as its query."""
    own = members.select("result_id", "node_id").distinct()
    a, b = own.withColumnRenamed("node_id", "a"), own.withColumnRenamed("node_id", "b")
    return a.join(b, "result_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def covariance(members: DataFrame) -> DataFrame:
    """``a, b, cov``: what each pair shares beyond chance, in results."""
    own = members.select("result_id", "node_id").distinct()
    total = own.agg(F.count_distinct("result_id").alias("total")).first().total
    counts = own.groupBy("node_id").agg(F.count("*").alias("n"))
    x, y = counts.toDF("a", "n_a"), counts.toDF("b", "n_b")
    return pairs(members).join(x, "a").join(y, "b").select("a", "b", cooccurrence(F.col("shared"), F.col("n_a"), F.col("n_b"), total).alias("cov"))


def guarded(found: DataFrame, most: int = MOST_PAIRS) -> DataFrame | None:
    """The pairs, or None if there are too many to overlay."""
    return None if found.limit(most).count() >= most else found


def with_source(sources: Column, source: str) -> Column:
    """The sources with one more unless it is there; null is none."""
    own = F.coalesce(sources, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, source), own).otherwise(F.array_append(own, F.lit(source)))


def overlaid(members: DataFrame, most: int | None = MOST_PAIRS) -> DataFrame:
    """``result_id, a, b, shared, n_a, n_b, edge_id, aux_id``: a support edge for each pair of nodes that a result binds, with the results that both
    nodes share and those of each, in the result's support graph. Beyond ``most`` pairs (None: no guard) nothing is overlaid."""
    own = members.select("result_id", "node_id").distinct()
    counts = own.groupBy("node_id").agg(F.count("*").alias("n"))
    found = pairs(members)
    if most is not None and (found := guarded(found, most)) is None:
        return overlaid(members.limit(0), None)
    a, b = own.withColumnRenamed("node_id", "a"), own.withColumnRenamed("node_id", "b")
    bound = a.join(b, "result_id").where("a < b").join(found, ["a", "b"])
    out = bound.join(counts.toDF("a", "n_a"), "a").join(counts.toDF("b", "n_b"), "b")
    return out.select("result_id", "a", "b", "shared", "n_a", "n_b", F.concat_ws("|", F.lit("omnicorp"), "a", "b").alias("edge_id"), F.concat(F.lit("OMNICORP_support_graph_"), F.col("result_id").cast("string")).alias("aux_id"))
