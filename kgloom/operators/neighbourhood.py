"""Personalised PageRank of many queries in one iteration, and neighbourhoods grown by it.

``links`` are ``query, subject, object``; ``targets`` and ``starts`` are ``query, node_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import drop, step

#: Out-links of a node that one task joins; a node with more has its rank sent to several.
HUB = 50_000
#: Rows that go to all tasks, counted first.
FEW = 500_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def personal_ranks(links: DataFrame, targets: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100, hub: int = HUB) -> DataFrame:
    """``query, node_id, r``: each query's PageRank over its distinct links, jumps and the mass of nodes without out-links
    spread evenly over those of its targets that are nodes, or over all nodes if none is.

    Ranks start even. A query whose ranks moved by less than ``tolerance`` times its nodes in sum has converged and takes no part in later
    steps; one that hasn't after ``most`` steps keeps the ranks it has.

    A node's rank is ``alpha * got + p * f``: what its links got it, and its share p of the query's jumps f. What links get from jumps is p summed over
    them once, so a step goes over the links of inner nodes alone, which have links in and out; the mass of nodes without out-links is what others
    leave of 1. Without a tolerance only inner nodes are ranked in each step, and all in the last.
    """
    pairs = step(links.select("query", "subject", "object").where("query is not null and subject is not null and object is not null").distinct(), "links")
    goals = targets.select("query", "node_id").distinct().withColumn("goal", F.lit(1))
    shards = (F.floor(F.col("degree") / hub) + 1).cast("int")
    givers = pairs.groupBy("query", F.col("subject").alias("node_id")).agg(F.count("*").alias("degree")).join(goals, ["query", "node_id"], "left")
    givers = step(givers.select("query", "node_id", "degree", shards.alias("shards"), F.coalesce("goal", F.lit(0)).alias("goal")), "givers")
    of = _few(givers.withColumnRenamed("node_id", "subject"), givers.count())
    met = pairs.join(of, ["query", "subject"]).groupBy("query", F.col("object").alias("node_id")).agg(F.sum(1 / F.col("degree")).alias("even"), F.sum(F.col("goal") / F.col("degree")).alias("aimed"))
    base = met.join(givers.select("query", "node_id", "degree", "shards"), ["query", "node_id"], "full").join(goals, ["query", "node_id"], "left")
    base = step(base, "base")
    asked = base.groupBy("query").agg(F.count("*").alias("size"), F.count("goal").alias("goals"), F.count("degree").alias("live"), F.count(F.when(F.col("degree").isNotNull(), F.col("goal"))).alias("live_goals"))
    aims = F.col("goals") > 0
    jumps = F.when(aims, F.col("live_goals") / F.col("goals")).otherwise(F.col("live") / F.col("size"))
    asked = step(asked.select("query", "size", "goals", jumps.alias("live_p"), (alpha * (1 - F.col("live") / F.col("size")) + 1 - alpha).alias("f")), "queries")
    n_asked = asked.count()
    p = F.when(aims, F.coalesce("goal", F.lit(0)) / F.col("goals")).otherwise(1 / F.col("size"))
    share = F.when(aims, F.col("aimed") / F.col("goals")).otherwise(F.col("even") / F.col("size"))
    inner = F.col("degree").isNotNull() & F.col("even").isNotNull()
    nodes = base.join(_few(asked, n_asked), "query")
    nodes = nodes.select("query", "node_id", "size", "degree", "shards", inner.alias("inner"), p.alias("p"), F.coalesce(share, F.lit(0.0)).alias("share"), (F.coalesce("even", F.lit(0.0)) / F.col("size")).alias("got"), (1 / F.col("size")).alias("r"))
    nodes = step(nodes, "nodes")
    drop(base, givers)
    if most < 1:
        drop(pairs, asked)
        return nodes.select("query", "node_id", "r")
    senders = nodes.where("inner").select("query", F.col("node_id").alias("subject"), "shards")
    inward = pairs.join(_few(senders, senders.count()), ["query", "subject"])
    inward = step(inward.select("query", F.col("subject").alias("node_id"), "object", F.pmod(F.xxhash64("object"), F.col("shards")).cast("int").alias("shard")), "inward")
    n_inward, done, queries = inward.count(), [], None
    drop(pairs)
    whole = tolerance > 0  # the ranks of all nodes tell whether a query has converged
    state = nodes if whole or most == 1 else step(nodes.where("inner"), "ranks")
    for k in range(1, most + 1):
        own = state.join(_few(asked.select("query", "f"), n_asked), "query").withColumn("now", alpha * F.col("got") + F.col("p") * F.col("f"))
        open_ = None
        if whole:
            ranks = step(own.select("query", "node_id", F.col("now").alias("r"), F.abs(F.col("now") - F.col("r")).alias("moved"), "size"), "moved")
            open_ = step(ranks.groupBy("query").agg(F.sum("moved").alias("error"), F.first("size").alias("size")).where(F.col("error") >= F.col("size") * tolerance).select("query"), "open")
            left = open_.count()
            if left != queries:  # a first step, or queries have converged
                done.append(step(ranks.join(open_, "query", "left_anti").select("query", "node_id", "r"), "converged"))
            queries = left
            if k == most or not left:
                out = ranks.join(open_, "query", "left_semi").select("query", "node_id", "r")
                break
        elif k == most:
            out = step(own.select("query", "node_id", F.col("now").alias("r")), "ranked")
            break
        sent = state.where("inner").select("query", "node_id", (F.col("got") / F.col("degree")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        moved = inward.join(_few(sent, n_inward), ["query", "node_id", "shard"]).groupBy("query", F.col("object").alias("node_id")).agg(F.sum("part").alias("more"))
        target = own if whole else nodes.join(_few(asked.select("query", "f"), n_asked), "query")
        if open_ is not None:
            target = target.join(open_, "query", "left_semi")
        elif k + 1 < most:
            target = target.where("inner")
        before = F.col("now" if whole else "r").alias("r")
        new = target.join(_few(moved, n_inward), ["query", "node_id"], "left").select("query", "node_id", "size", "degree", "shards", "inner", "p", "share", (F.col("f") * F.col("share") + alpha * F.coalesce("more", F.lit(0.0))).alias("got"), before)
        new = step(new, "ranks")
        held = state.where("inner").groupBy("query").agg(F.sum("got").alias("held"))
        lost = 1 - alpha * F.coalesce("held", F.lit(0.0)) - F.col("f") * F.col("live_p")
        after = step(asked.join(held, "query", "left").select("query", "size", "goals", "live_p", (alpha * F.greatest(lost, F.lit(0.0)) + 1 - alpha).alias("f")), "queries")
        drop(*([state] if state is not nodes else []), asked, *([ranks, open_] if whole else []))
        state, asked = new, after
    drop(inward, asked, state, nodes)
    for d in done:
        out = out.unionByName(d)
    return out


def allowed(subject: Column, object_: Column, predicate: Column, without: Sequence[str], prefix: str) -> Column:
    """Edges of other predicates whose ends don't both have the prefix."""
    return ~predicate.isin(list(without)) & ~(subject.startswith(prefix) & object_.startswith(prefix))


def neighbourhood(edges: DataFrame, starts: DataFrame, without: Sequence[str], prefix: str, hops: int = 2, best: int = 15, tolerance: float = 1e-6, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """The nodes ``query, hop, node_id, rank, score`` and edges ``query, hop, edge_id, subject, object`` that ``hops`` steps keep.

    A step takes the allowed edges at the nodes that the step before kept and none had used, ranks their ends with those nodes as
    targets, keeps the ``best`` without the prefix (ties by id), and the edges that touch one of them with a score above 0.
    """
    used = frontier = starts.select("query", "node_id").distinct()
    nodes, kept_edges = None, None
    # each step reads them
    own_edges = step(edges.where(allowed(F.col("subject"), F.col("object"), F.col("predicate"), without, prefix)).select("edge_id", "subject", "object"), "allowed")
    for hop in range(1, hops + 1):
        frontier = step(frontier, "frontier")
        at_end = _few(frontier, frontier.count())
        ends = [own_edges.join(at_end.withColumnRenamed("node_id", end), end).select("query", "edge_id", "subject", "object") for end in ("subject", "object")]
        near = step(ends[0].union(ends[1]), "near")  # an edge may come by both ends: links and kept edges are made distinct
        ranks = personal_ranks(near, frontier, tolerance=tolerance, most=most)
        order = W.partitionBy("query").orderBy(F.desc(F.round("r", 12)), "node_id")
        own = ranks.where(~F.col("node_id").startswith(prefix)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        own = step(own.select("query", F.lit(hop).alias("hop"), "node_id", "rank", F.col("r").alias("score")), "best")
        alive = own.where("score > 0").select("query", "node_id")
        at = lambda end: near.join(alive.withColumnRenamed("node_id", end), ["query", end], "left_semi").select("query", F.lit(hop).alias("hop"), "edge_id", "subject", "object")  # noqa: B023, E731
        found = step(at("subject").union(at("object")).distinct(), "edges")
        drop(near)
        nodes, kept_edges = (own, found) if nodes is None else (nodes.unionByName(own), kept_edges.unionByName(found))
        frontier = own.select("query", "node_id").join(used, ["query", "node_id"], "left_anti")
        used = used.unionByName(frontier)
    drop(own_edges)
    return nodes, kept_edges
