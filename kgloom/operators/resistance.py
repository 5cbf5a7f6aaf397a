"""Effective resistance in many small graphs at once, by eliminating nodes from an edge table.

A result's graph has a node for each query node and one for each support node; its edges are resistors. The score is
``exp(-sum)`` of the effective resistances between all pairs of probes. Graphs of up to ``SMALL`` rows are scored after one shuffle, all of one
size in a batch together by NumPy; larger ones over an edge table, by the same steps. All nodes but the probes are eliminated by star-mesh
steps: a node with conductances ``g_i`` and sum ``G`` gives way to edges ``g_i * g_j / G`` between its neighbours. A round takes, in every graph
at once, the nodes of lower degree than all neighbours that will go too, so few rounds do; each is a handful of joins
over the edge table. A step's mesh has as many edges as a node has pairs of neighbours in its own graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kgloom.operators import graphs
from kgloom.operators.checkpoints import drop, step

#: An edge from a node to itself leads to this node, as a resistor to ground.
GROUND = "\x00ground"
#: Edges and probes of a graph that one task holds as a matrix; a larger graph stays a table.
SMALL = 256


def rnode_edges(edges: DataFrame, nodes: DataFrame, bindings: DataFrame, kg: DataFrame) -> DataFrame:
    """``result_id, u, v, edge_id``: each edge of a result (``result_id, edge_id``) between the result's nodes that stand for its ends.

    A bound node stands for every query node that binds it (``bindings``: result_id, qnode, knode), another node (``nodes``:
    result_id, node_id) for itself, as ``support_node_`` and its id. Edges that ``kg`` lacks, and ends without a node, give none.
    """
    # one shuffle by result for each table; the joins and counts of a result's pairs stay in it
    bound = bindings.select("result_id", F.col("knode").alias("node_id"), F.col("qnode").alias("rnode")).repartition("result_id").distinct()
    others = nodes.select("result_id", "node_id").repartition("result_id").distinct().join(bound, ["result_id", "node_id"], "left_anti")
    places = bound.unionByName(others.withColumn("rnode", F.concat(F.lit("support_node_"), "node_id")))
    known = edges.select("result_id", "edge_id").join(kg.select("edge_id", "subject", "object"), "edge_id").repartition("result_id")
    u, v = (places.select("result_id", F.col("node_id").alias(end), F.col("rnode").alias(name)) for end, name in (("subject", "u"), ("object", "v")))
    return known.join(u, ["result_id", "subject"]).join(v, ["result_id", "object"]).select("result_id", "u", "v", "edge_id").distinct()


def conductances(edges: DataFrame, admittances: DataFrame, qedges: DataFrame, default: float) -> DataFrame:
    """``result_id, u, v, g``: between two nodes each edge (``rnode_edges``) counts once, with its ``admittance`` (``edge_id, admittance``);
    two query nodes with a query edge (``result_id, u, v``) get ``default`` besides, also without an edge."""
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    own = edges.select("result_id", *ends, "edge_id").distinct().join(admittances, "edge_id").select("result_id", "u", "v", F.col("admittance").alias("g"))
    asked = qedges.select("result_id", *ends).distinct().withColumn("g", F.lit(default))
    return own.unionByName(asked).groupBy("result_id", "u", "v").agg(F.sum("g").alias("g"))


def wired(rows: DataFrame, bound: DataFrame, parts: int) -> DataFrame:
    """``result_id, u, v, g``: ``conductances`` of ``rnode_edges`` without query edges, all made in partitions by result after one shuffle,
    ``parts`` of them if that is more than the session's.

    ``rows``: result_id, edge_id, subject, object, gives, admittance (``graphs.ranker_rows``: repeated rows, one subject, object and admittance an edge id,
    null where the edge is unknown); ``bound``: result_id, binds (a map of query nodes to lists of the nodes that they bind).
    """
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = dict(rows.dtypes)
    own = rows.select("result_id", "edge_id", "subject", "object", "gives", "admittance", none("binds", dict(bound.dtypes)["binds"]))
    more = bound.select("result_id", *(none(c, kind[c]) for c in ("edge_id", "subject", "object")), F.lit(False).alias("gives"), none("admittance", kind["admittance"]), "binds")
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as AQE would put them together to tasks that spill
    stream = own.unionByName(more).repartition(max(parts, usual), "result_id")
    # a row an end of an edge, a node of a support graph or a bound node
    at = lambda node, end, qnode=None: F.struct(node.alias("node"), F.lit(end).cast("string").alias("end"), F.lit(None).cast("string").alias("qnode") if qnode is None else qnode.alias("qnode"))
    bindings = F.flatten(F.transform(F.map_entries("binds"), lambda b: F.transform(b["value"], lambda k: at(k, None, b["key"]))))
    each = stream.select("result_id", "edge_id", "gives", "admittance", F.explode(F.when(F.col("binds").isNull(), F.array(at(F.col("subject"), "u"), at(F.col("object"), "v"))).otherwise(bindings)).alias("e"))
    each = each.select("result_id", "edge_id", "gives", "admittance", "e.*").where("node is not null")
    here = W.partitionBy("result_id", "node")
    each = each.withColumns({"names": F.collect_set("qnode").over(here), "known": F.max("gives").over(here)}).where("edge_id is not null and admittance is not null and (known or size(names) > 0)")
    names = F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.concat(F.lit("support_node_"), F.col("node").cast("string"))))
    end = lambda name: F.first(F.when(F.col("end") == name, names), ignorenulls=True).alias(name)
    whole = each.groupBy("result_id", "edge_id").agg(end("u"), end("v"), F.first("admittance").alias("g"))
    pairs = whole.select("result_id", "edge_id", "g", F.explode("u").alias("a"), "v").select("result_id", "edge_id", "g", "a", F.explode("v").alias("b"))
    # between two nodes an edge counts once
    once = pairs.groupBy("result_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "edge_id").agg(F.first("g").alias("g"))
    return once.groupBy("result_id", "u", "v").agg(F.sum("g").alias("g"))


def eliminated(edges: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """The edges ``key, u, v, g`` between the nodes of ``keep`` (``key, node``) that act alike there; parallel edges are added."""
    looped = F.col("u") == F.col("v")
    u, v = F.col("u"), F.when(looped, F.lit(GROUND)).otherwise(F.col("v"))
    add = lambda df: df.groupBy(key, "u", "v").agg(F.sum("g").alias("g"))
    own = step(add(edges.where("g > 0").select(key, F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "g")), "elimination")
    kept = keep.select(key, F.col("node").alias("n")).distinct()
    while True:
        ends = own.select(key, F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e"), "g").select(key, "e.n", "e.m", "g")
        inner = ends.join(kept, [key, "n"], "left_anti")
        size = inner.groupBy(key, "n").agg(F.count("*").alias("d"), F.sum("g").alias("total"))
        rivals = inner.join(size.select(key, F.col("n").alias("m"), F.col("d").alias("dm")), [key, "m"]).groupBy(key, "n").agg(F.min(F.struct("dm", "m")).alias("rival"))
        least = F.col("rival").isNull() | (F.struct(F.col("d").alias("dm"), F.col("n").alias("m")) < F.col("rival"))
        gone = step(size.join(rivals, [key, "n"], "left").where(least).select(key, "n", "total"), "eliminated")
        if not gone.take(1):
            drop(gone)
            return own
        star = inner.join(gone, [key, "n"])
        a, b = star.select(key, "n", F.col("m").alias("u"), F.col("g").alias("ga"), "total"), star.select(key, "n", F.col("m").alias("v"), F.col("g").alias("gb"))
        mesh = a.join(b, [key, "n"]).where("u < v").select(key, "u", "v", (F.col("ga") * F.col("gb") / F.col("total")).alias("g"))
        rest = own
        for end in ("u", "v"):
            rest = rest.join(gone.select(key, F.col("n").alias(end)), [key, end], "left_anti")
        new = step(add(rest.unionByName(mesh)), "elimination")
        drop(own, gone)
        own = new


def resistances(edges: DataFrame, probes: DataFrame, key: str = "result_id") -> DataFrame:
    """``key, a, b, r``: the effective resistance between each two probes (``key, node``) of a graph; null without a way."""
    between = eliminated(edges, probes, key)
    own = probes.select(key, "node").distinct()
    pairs = own.select(key, F.col("node").alias("a")).join(own.select(key, F.col("node").alias("b")), key).where("a < b").withColumn("pair", F.struct(key, "a", "b"))
    ends = pairs.select("pair", F.explode(F.array("a", "b")).alias("node"))
    last = eliminated(pairs.join(between, key).select("pair", "u", "v", "g"), ends, "pair")
    out = pairs.join(last.select("pair", "g"), "pair", "left").select(key, "a", "b", (1 / F.col("g")).alias("r"))
    out = step(out, "resistances")
    drop(between, last)
    return out


def _without_first(g: np.ndarray, n: int) -> np.ndarray:
    """The symmetric conductances ``g`` (graph, node, node) without the first ``n`` nodes of each graph, by star-mesh steps; diagonals are no edges."""
    for _ in range(n):
        row, g = g[:, 0, 1:], g[:, 1:, 1:]
        total = row.sum(axis=1)
        g = g + row[:, :, None] * (row / np.where(total > 0, total, 1.0)[:, None])[:, None, :]
    return g


def _probe_scores(g: np.ndarray, n_probes: int, grounded: bool) -> np.ndarray:
    """The score of each graph of one size, probes last and the ground, if there is one, first. Where probes aren't joined, the least-squares potentials of that graph count."""
    size = g.shape[1]
    between, total = _without_first(g, size - n_probes), np.zeros(len(g))
    for a, b in combinations(range(n_probes), 2):
        order = [i for i in range(n_probes) if i not in (a, b)] + [a, b]
        with np.errstate(divide="ignore"):
            total += 1 / _without_first(between[:, order][:, :, order], n_probes - 2)[:, 0, 1]
    score = np.exp(-total)
    for i in np.flatnonzero(~np.isfinite(total)):
        whole = g[i] * (1 - np.eye(size))
        laplacian = (np.diag(whole.sum(axis=1)) - whole)[grounded:, grounded:]  # the ground has no potential
        score[i] = graphs.effective_resistance(laplacian, list(combinations(range(len(laplacian) - n_probes, len(laplacian)), 2)))
    return score


def _scored(rows: pa.Table) -> pa.RecordBatch:
    """``key, score, large`` of the graphs in ``rows`` (key, u, v, g, probe), whose rows lie together; a large one gets no score."""
    codes = lambda c: c.dictionary_encode().indices.to_numpy()
    key = codes(rows.column(0).combine_chunks())
    _, first, graph, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    n_graphs, large = len(first), count > SMALL
    score = np.full(n_graphs, np.nan)
    u, v = rows.column(1).combine_chunks(), rows.column(2).combine_chunks()
    probe = rows.column(4).to_numpy()
    looped = pc.and_(pc.equal(u, v), pc.invert(rows.column(4).combine_chunks()))
    names = codes(pa.concat_arrays([pa.array([GROUND], u.type), u, pc.if_else(looped, pa.scalar(GROUND, u.type), v)])).astype(np.int64)[1:]  # the ground is 0
    each, many = np.concatenate([graph, graph]), int(names.max(initial=0)) + 1
    nodes, at = np.unique(each * many + names, return_inverse=True)
    owner, ground, is_probe, has_edge = nodes // many, nodes % many == 0, np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    is_probe[at[np.concatenate([probe, probe])]] = True
    has_edge[at[~np.concatenate([probe, probe])]] = True
    size, probes = np.bincount(owner, minlength=n_graphs), np.bincount(owner[is_probe], minlength=n_graphs)
    bare = np.bincount(owner[is_probe & ~has_edge], minlength=n_graphs) > 0
    grounded = np.bincount(owner[ground], minlength=n_graphs)
    place = np.empty(len(nodes), np.int64)  # of a node in its graph, the ground first and probes last
    place[np.lexsort((~ground, is_probe, owner))] = np.arange(len(nodes)) - np.repeat(np.cumsum(size) - size, size)
    a, b, w = place[at[: len(graph)]], place[at[len(graph) :]], np.where(probe, 0.0, rows.column(3).to_numpy())
    score[probes < 2] = -1.0
    score[bare] = 0.0
    open_, shape = ~large & ~bare & (probes > 1), (size * (SMALL + 2) + probes) * 2 + grounded
    for s in np.unique(shape[open_]):
        own = np.flatnonzero(open_ & (shape == s))
        n, p = int(size[own[0]]), int(probes[own[0]])
        slot = np.full(n_graphs, -1)
        slot[own] = np.arange(len(own))
        mine = slot[graph] >= 0
        flat = (slot[graph[mine]] * n + a[mine]) * n + b[mine]
        half = np.bincount(flat, w[mine], len(own) * n * n).reshape(len(own), n, n)
        score[own] = _probe_scores(half + half.transpose(0, 2, 1), p, bool(grounded[own[0]]))
    asked = large | (probes > 0)
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first[asked])).combine_chunks(), pa.array(score[asked], mask=large[asked]), pa.array(large[asked])], names=["key", "score", "large"])


def scores(edges: DataFrame, probes: DataFrame, key: str = "result_id") -> DataFrame:
    """``key, score`` of each graph with a probe: ``exp(-sum of the resistances between its probes)``; 0 if a probe has no edge, -1 with fewer
    than two probes. Where probes aren't joined by a way, the least-squares potentials of the whole graph stand in for the resistance;
    those graphs alone are solved as matrices. Rows without a key or a node are passed over."""
    kind = dict(edges.dtypes)[key]
    whole = "key is not null and u is not null and v is not null"
    wired = edges.where("g > 0").select(F.col(key).alias("key"), "u", "v", F.col("g").cast("double").alias("g"), F.lit(False).alias("probe"))
    ends = probes.select(F.col(key).cast(kind).alias("key"), F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("g"), F.lit(True).alias("probe"))
    rows = wired.unionByName(ends).where(whole)
    arrow = pa.schema([("key", to_arrow_type(rows.schema["key"].dataType)), ("score", pa.float64()), ("large", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a graph that the next batch may go on with; of one that is large already, no more than show that
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            own = own if held is None else pa.concat_tables([held, own])
            last = pc.index(own.column(0), own.column(0)[-1]).as_py()
            if last:
                yield _scored(own.slice(0, last)).cast(arrow)
            held = own.slice(last, SMALL + 1)
        if held is not None:
            yield _scored(held).cast(arrow)

    solved = step(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key {kind}, score double, large boolean"), "scores")
    out = solved.where("not large").select(F.col("key").alias(key), "score")
    beyond = solved.where("large").select(F.col("key").alias(key))
    if beyond.take(1):
        own = step(edges.join(beyond, key, "left_semi"), "large")  # each round's start reads it
        out = out.unionByName(table_scores(own, probes.join(beyond, key, "left_semi"), key).select(key, "score"))
    return out


def table_scores(edges: DataFrame, probes: DataFrame, key: str = "result_id") -> DataFrame:
    """The same of graphs of any size over their edge table, in rounds of joins."""
    own = probes.select(key, "node").distinct()
    found = resistances(edges, own, key)
    wired = edges.where("g > 0").select(key, F.explode(F.array("u", "v")).alias("node")).distinct()
    bare = own.join(wired, [key, "node"], "left_anti").select(key).distinct().withColumn("bare", F.lit(True))
    apart = found.where("r is null").select(key).distinct().join(bare, key, "left_anti")
    summed = found.groupBy(key).agg(F.exp(-F.sum("r")).alias("score")).join(apart, key, "left_anti")
    rows = edges.where("g > 0").select(key, "u", "v", F.col("g").alias("w"), F.lit(False).alias("probe")).unionByName(own.select(key, F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("w"), F.lit(True).alias("probe")))
    solved = graphs.score_graphs(rows.join(apart, key, "left_semi"), graphs.resistance_score, key, places=15)
    score = F.when(F.col("bare"), 0.0).otherwise(F.coalesce("score", F.lit(-1.0)))
    return own.select(key).distinct().join(bare, key, "left").join(summed.unionByName(solved), key, "left").select(key, score.alias("score"))
