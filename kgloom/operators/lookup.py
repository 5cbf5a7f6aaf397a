"""Pattern matching of small query graphs over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import drop, step

#: Nodes of a hop that go to all tasks, counted first.
FEW = 500_000


def match(query_graph: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bind each query edge to an edge that has its predicates and whose ends have the query nodes' ids and categories.

    ``query_graph``: ``nodes`` {name: {ids?, categories?}} and ``edges`` {name: {subject, object, predicates?}}. The result has
    ``n_<node>`` and ``e_<edge>`` columns. Constraints are filters below the joins; query edges join on the nodes they share,
    those with the fewest unpinned nodes first, so each join has a key.
    """
    qnodes, left = query_graph["nodes"], dict(query_graph["edges"])
    if not left:
        raise ValueError("a query graph needs an edge")

    def bound(name: str, e: dict) -> DataFrame:
        df = edges
        if e.get("predicates"):
            df = df.where(F.col("predicate").isin(e["predicates"]))
        for end in ("subject", "object"):
            q = qnodes[e[end]]
            if q.get("ids"):
                df = df.where(F.col(end).isin(q["ids"]))
        df = df.select(F.col("subject").alias(f"n_{e['subject']}"), F.col("object").alias(f"n_{e['object']}"), F.col("edge_id").alias(f"e_{name}"))
        for end in ("subject", "object"):
            if cats := qnodes[e[end]].get("categories"):
                having = nodes.where(F.col("kind").isin(cats) | F.col("cat1").isin(cats) | F.col("cat2").isin(cats)).select(F.col("node_id").alias(f"n_{e[end]}"))
                df = df.join(having, f"n_{e[end]}", "left_semi")
        return df

    def open_ends(e: dict) -> int:
        return sum(not qnodes[e[end]].get("ids") for end in ("subject", "object"))

    name = min(left, key=lambda k: (open_ends(left[k]), k))
    out, seen = bound(name, left[name]), {left[name]["subject"], left[name]["object"]}
    del left[name]
    while left:
        touching = [k for k, e in left.items() if {e["subject"], e["object"]} & seen]
        if not touching:
            raise ValueError("the query graph is not connected")
        name = min(touching, key=lambda k: (open_ends(left[k]), k))
        e = left.pop(name)
        out = out.join(bound(name, e), [f"n_{q}" for q in {e["subject"], e["object"]} & seen])
        seen |= {e["subject"], e["object"]}
    return out


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, hop`` of every node within ``depth`` undirected hops of ``start`` (``node``), at its first hop.

    The edges' ends are stored once, as they are; a hop reads them from both ends, and nodes counted as few go to all tasks, so that no edge is shuffled.
    """
    pairs = step(edges.select("subject", "object"), "ends")
    found = frontier = start.select("node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, depth + 1):
        own = frontier.select("node")
        own = F.broadcast(own) if frontier.count() <= FEW else own
        ways = [pairs.join(own, pairs[a] == own["node"], "left_semi").select(F.col(b).alias("node")) for a, b in (("subject", "object"), ("object", "subject"))]
        reached = ways[0].union(ways[1]).distinct()
        frontier = step(reached.join(found, "node", "left_anti").select("node", F.lit(hop).alias("hop")), "hop")
        found = found.union(frontier)
    drop(pairs)
    return found
