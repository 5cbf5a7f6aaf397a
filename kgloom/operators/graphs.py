"""Graph operators over node and edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import drop, kept, step


#: Ranks above 0 that go to all tasks, counted before each step.
FEW = 100_000


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subject").alias("node_id")).union(edges.select("object"))
    return nodes.join(ends, "node_id", "left_semi")


def by_weight(edges: DataFrame, cutoff: float, weight: str, keep_above: bool = True) -> DataFrame:
    """Edges at or beyond a cutoff; a missing weight is 0."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return edges.where(w >= cutoff if keep_above else w <= cutoff)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge_id, node_id`` of endpoints that no node has."""
    ends = edges.select("edge_id", F.explode(F.array("subject", "object")).alias("node_id"))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select("edge_id", "node_id")


def collapsed(edges: DataFrame, weight: F.Column, how: str = "sum") -> DataFrame:
    """One edge for each ordered pair; parallel weights by sum, max, min, first (by edge_id) or pairwise running mean."""
    g = edges.withColumn("w", weight).groupBy("subject", "object")
    if how in ("max", "min"):
        return g.agg(getattr(F, how)("w").alias("w"))
    if how == "first":
        return g.agg(F.min_by("w", "edge_id").alias("w"))
    if how == "mean":
        own = F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "w"))), lambda x: x["w"])
        return g.agg(F.aggregate(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), own[0], lambda acc, x: 0.5 * (acc + x)).alias("w"))
    return g.agg(F.sum("w").alias("w"))


def shaped(edges: DataFrame, weight: str, default: float = 0.0, directed: bool = True, multi: bool = False) -> DataFrame:
    """``u, v, parallel, w``: the edges as a directed or undirected graph, one row an edge or, collapsed, one a pair with weights added. A missing weight
    is the default; an edge without an end is none."""
    u, v = (F.col("subject"), F.col("object")) if directed else (F.least("subject", "object"), F.greatest("subject", "object"))
    own = edges.where("subject is not null and object is not null").select(u.alias("u"), v.alias("v"), F.coalesce(weight, F.lit(default)).alias("w"))
    return own.select("u", "v", F.lit(1).cast("long").alias("parallel"), "w") if multi else own.groupBy("u", "v").agg(F.count("*").alias("parallel"), F.sum("w").alias("w"))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with one end or both among ``node_id``; a semi-join an end, so that no edge comes twice."""
    s, o = nodes.select(F.col("node_id").alias("subject")), nodes.select(F.col("node_id").alias("object"))
    return edges.join(s, "subject", "left_semi").unionByName(edges.join(s, "subject", "left_anti").join(o, "object", "left_semi"))


def frobenius(edges: DataFrame, weight: F.Column) -> DataFrame:
    """The norm of the adjacency matrix, parallel edges added."""
    return collapsed(edges, weight).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def pagerank(edges: DataFrame, targets: DataFrame, iterations: int = 10, alpha: float = 0.85) -> DataFrame:
    """Personalized PageRank after ``iterations`` steps over distinct directed pairs of ``subject, object``.

    Mass jumps to ``targets`` (``node_id``), as that of nodes without out-edges does; to all nodes evenly if no target is a node. A step is a
    join and an aggregation over the stored links of nodes whose rank isn't 0.
    """
    pairs = step(edges.select("subject", "object").distinct(), "pairs")
    out = pairs.groupBy("subject").agg(F.count("*").alias("degree"))
    nodes = pairs.select(F.col("subject").alias("node_id")).union(pairs.select("object")).distinct()
    base = step(nodes.join(targets.select("node_id").distinct().withColumn("goal", F.lit(True)), "node_id", "left").join(out.select(F.col("subject").alias("node_id"), "degree"), "node_id", "left"), "nodes")
    links = step(pairs.join(out, "subject"), "links")  # each step reads it
    drop(pairs)
    jump = base.where("goal")
    n = jump.count()
    if not n:
        jump, n = base, base.count()
    jump = step(jump.select("node_id", F.lit(1.0 / max(1, n)).alias("p")), "jump")
    dead = base.where("degree is null").select("node_id")
    rank = step(jump.select("node_id", F.col("p").alias("r")), "ranks")
    for _ in range(iterations):
        # a node of rank 0 gives nothing; few ranks go to all tasks, so that the links stay where they are
        few = rank.count() <= FEW
        own = F.broadcast(rank) if few else rank
        lost = dead.join(own, "node_id").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        moved = links.join(own, links["subject"] == own["node_id"]).groupBy(F.col("object").alias("node_id")).agg(F.sum(F.col("r") / F.col("degree")).alias("got"))
        got, p = F.coalesce("got", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
        new = moved.join(jump, "node_id", "full").join(F.broadcast(lost)).select("node_id", (alpha * (got + F.col("lost") * p) + (1 - alpha) * p).alias("r"))
        new = step(new.where("r <> 0"), "ranks")  # it is read again in the next step
        drop(rank)
        rank = new
    drop(links, jump)
    return base.select("node_id").join(rank, "node_id", "left").fillna(0.0, ["r"])


def support_closure(edges: DataFrame, supports: DataFrame, aux: DataFrame) -> DataFrame:
    """``edge_id, depth`` of every edge reached from ``edges`` (``edge_id``) by support graphs.

    ``supports``: edge_id, aux_id; ``aux``: aux_id, edge_id. Each edge counts once, so cycles end; a dangling reference is passed
    over. One job a level.
    """
    steps = supports.join(aux.withColumnRenamed("edge_id", "to"), "aux_id").select("edge_id", "to").distinct()
    steps = kept(steps)  # each level reads it
    found = kept(edges.select("edge_id", F.lit(0).alias("depth")).distinct())
    frontier = found
    for depth in count(1):
        new = steps.join(frontier.select("edge_id"), "edge_id").select(F.col("to").alias("edge_id")).distinct()
        frontier = kept(new.join(found, "edge_id", "left_anti").select("edge_id", F.lit(depth).alias("depth")))
        if not frontier.take(1):
            break
        found = found.union(frontier)
        if depth % 10 == 0:  # a plan of few parts, however deep the chain
            found = kept(found)
    return found


def ranker_rows(own: DataFrame, edges: DataFrame, supports: DataFrame, aux_nodes: DataFrame, more: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """``result_id, edge_id, subject, object, gives`` and the edges' columns ``more``: what each result's graph holds as its ranker sees it, a row
    repeated if it is met twice, and the stored tables that the rows are read from.

    ``own``: result_id, aux_id, edge_id, an edge that a result binds or a support graph holds, or both of one row's; the rest as in
    ``ranker_closure``. ``gives`` tells whether a row's ends are nodes of the graph; a support graph's node is a row's subject without an edge.
    """
    ends = edges.select("edge_id", F.col("subject"), F.col("object"), "described", *more, F.lit(True).alias("known"))
    to = supports.select("edge_id", F.col("aux_id").alias("to")).distinct()
    # one join an edge for all that results and support graphs hold; the walk is over support graphs, which are fewer than their edges
    met = own.join(ends, "edge_id", "left").join(to, "edge_id", "left")
    placed = step(met.select("result_id", "aux_id", "edge_id", "subject", "object", "described", "known", *more, F.when(F.col("described"), F.col("to")).alias("to")), "placed")
    links = step(placed.where("aux_id is not null and to is not null").select("aux_id", "to").distinct(), "links")
    found = frontier = step(placed.where("result_id is not null and to is not null").select("result_id", F.col("to").alias("aux_id")).distinct(), "walk")
    parts = [found]
    for depth in count(1):
        new = frontier.join(links, "aux_id").select("result_id", F.col("to").alias("aux_id")).distinct()
        frontier = step(new.join(found, ["result_id", "aux_id"], "left_anti"), "walk")
        parts.append(frontier)
        if not frontier.take(1):
            break
        found = found.unionByName(frontier)
        if depth % 10 == 0:  # a plan of few parts, however deep the chain
            found = step(found, "walk")
            drop(*(p for p in parts if p is not frontier))
            parts = [frontier, found]
    first = placed.where("result_id is not null").select("result_id", "edge_id", "subject", "object", F.coalesce("described", F.lit(False)).alias("gives"), *more)
    kind, gives = dict(placed.dtypes), F.lit(True).alias("gives")
    held = placed.where("aux_id is not null and known").select("aux_id", "edge_id", "subject", "object", gives, *more)
    named = aux_nodes.select("aux_id", F.lit(None).cast(kind["edge_id"]).alias("edge_id"), F.col("node_id").alias("subject"), F.lit(None).cast(kind["object"]).alias("object"), gives, *(F.lit(None).cast(kind[c]).alias(c) for c in more))
    return first.unionByName(found.join(held.unionByName(named), "aux_id").select(first.columns)), [placed, links, *parts]


def ranker_closure(bound: DataFrame, edges: DataFrame, supports: DataFrame, aux_edges: DataFrame, aux_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges ``result_id, edge_id`` and nodes ``result_id, node_id`` of each result's graph as its ranker sees it.

    ``bound``: result_id, edge_id; ``edges``: edge_id, subject, object, described (whether it has attributes); ``supports``: edge_id, aux_id;
    ``aux_edges``: aux_id, edge_id; ``aux_nodes``: aux_id, node_id. A described edge leads to the edges and nodes of its support graphs; others
    are reached, but don't lead on, and a bound one among them gives no nodes. Unknown edges and support graphs are passed
    over, though a bound edge stays as it is. Each edge counts once a result, so cycles end.
    """
    key = {c: t for c, t in bound.dtypes + aux_edges.dtypes if c in ("result_id", "aux_id")}
    own = bound.select("result_id", F.lit(None).cast(key["aux_id"]).alias("aux_id"), "edge_id").unionByName(aux_edges.select(F.lit(None).cast(key["result_id"]).alias("result_id"), "aux_id", "edge_id"))
    rows, stored = ranker_rows(own, edges, supports, aux_nodes)
    rows = rows.select("result_id", "edge_id", *(F.when(F.col("gives"), F.col(c)).alias(c) for c in ("subject", "object"))).repartition("result_id")  # edges and nodes are told apart and counted once in these partitions
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("edge", "edge_id"), ("node", "subject"), ("node", "object")))))
    whole = step(rows.select("result_id", each.alias("e")).select("result_id", "e.kind", "e.id").where("id is not null").distinct(), "closure")
    drop(*stored)
    return tuple(whole.where(F.col("kind") == kind).select("result_id", F.col("id").alias(f"{kind}_id")) for kind in ("edge", "node"))


def pruned(nodes: DataFrame, edges: DataFrame, bound_nodes: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that results reach: reached edges, their endpoints, and bound nodes."""
    kept = edges.join(reached.select("edge_id"), "edge_id", "left_semi")
    ends = kept.select(F.col("subject").alias("node_id")).union(kept.select("object")).union(bound_nodes.select("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi"), kept


def effective_resistance(laplacian: np.ndarray, pairs: list[tuple[int, int]]) -> float:
    """``exp(-sum of resistances)`` between node pairs: least squares of unit currents; -1 where undefined, 0 for a node alone."""
    total = 0.0
    for i, j in pairs:
        if not laplacian[:, i].any() or not laplacian[:, j].any():
            return 0.0
        current = np.zeros(len(laplacian))
        current[i], current[j] = 1.0, -1.0
        potential = np.linalg.lstsq(laplacian, current, rcond=None)[0]
        r = potential[i] - potential[j]
        if np.isnan(r) or r < 0:
            return -1.0
        total += r
    return float(np.exp(-total))


def _matrix(g: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A graph's nodes, its weights and which ordered pairs have an edge; one of weight 0 is an edge like any other, so it counts as a hop."""
    names = sorted(set(g["u"]) | set(g["v"]))
    at = {n: i for i, n in enumerate(names)}
    a, wired = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), bool)
    ends = [at[u] for u in g["u"]], [at[v] for v in g["v"]]
    np.add.at(a, ends, g["w"].to_numpy(float))
    wired[ends] = True
    return names, a, wired


def distances(adjacent: np.ndarray) -> np.ndarray:
    """Hops between all nodes of each directed graph (graph, node, node); -1 where there is no way."""
    n = adjacent.shape[1]
    step, at = adjacent.astype(np.float32), np.broadcast_to(np.eye(n, dtype=bool), adjacent.shape)
    out = np.where(at, 0, -1)
    for hops in range(1, n):
        at = (at.astype(np.float32) @ step > 0) & (out < 0)
        if not at.any():
            break
        out[at] = hops
    return out


def max_flows(capacity: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The largest flow from ``s`` to ``t`` in each graph (graph, node, node), by shortest augmenting paths of all graphs at once."""
    left, flow, open_ = capacity.astype(float), np.zeros(len(capacity)), np.arange(len(capacity))
    while len(open_):
        own, n = left[open_], np.arange(len(open_))
        free, above = own > 1e-12, np.full(own.shape[:2], -1)
        above[n, s[open_]] = s[open_]
        at = above >= 0
        while at.any():
            ways = free & at[:, :, None]
            at = ways.any(axis=1) & (above < 0)
            above[at] = ways.argmax(axis=1)[at]
            at &= (above[n, t[open_]] < 0)[:, None]  # a graph whose end is reached waits for the others
        met = above[n, t[open_]] >= 0
        open_, above = open_[met], above[met]
        way, v = [], t[open_].copy()
        rows = np.arange(len(open_))
        while len(rows):  # back from the ends, those graphs that aren't at their start yet
            u = above[rows, v[rows]]
            way.append((rows, u, v[rows]))
            v[rows] = u
            rows = rows[u != s[open_[rows]]]
        least = np.full(len(open_), np.inf)
        for rows, u, w in way:
            least[rows] = np.minimum(least[rows], left[open_[rows], u, w])
        for rows, u, w in way:
            left[open_[rows], u, w] -= least[rows]
            left[open_[rows], w, u] += least[rows]
        flow[open_] += least
    return flow


def max_flow(capacity: np.ndarray, s: int, t: int) -> float:
    return float(max_flows(capacity[None], np.array([s]), np.array([t]))[0])


def _noisy_or_of(graph: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` graphs the noisy-or of its values; 0 without one."""
    missed = np.ones(n)
    np.multiply.at(missed, graph, 1 - values)
    return 1 - missed


def max_flow_scores(a: np.ndarray, wired: np.ndarray) -> np.ndarray:
    """For each graph of one size (weights and edges: graph, node, node) the noisy-or of the flows between the pairs of nodes that are farthest
    apart; 1 for a node alone."""
    if a.shape[1] <= 1:
        return np.ones(len(a))
    d = distances(wired)
    far = d.max(axis=(1, 2))
    graph, s, t = np.nonzero((d == far[:, None, None]) & (far > 0)[:, None, None])
    return _noisy_or_of(graph, max_flows(a[graph], s, t), len(a))


def longest_path_scores(a: np.ndarray, wired: np.ndarray) -> np.ndarray:
    """For each graph the noisy-or over the pairs farthest apart, at L hops, of the walks ``A**L / L!`` between them."""
    d = distances(wired)
    far, walks = d.max(axis=(1, 2)), np.broadcast_to(np.eye(a.shape[1]), a.shape).copy()
    for hops in range(1, int(far.max(initial=0)) + 1):
        longer = far >= hops
        walks[longer] = walks[longer] @ a[longer] / hops
    graph, s, t = np.nonzero(d == far[:, None, None])
    return _noisy_or_of(graph, walks[graph, s, t], len(a))


def max_flow_score(g: pd.DataFrame) -> float:
    _, a, wired = _matrix(g)
    return float(max_flow_scores(a[None], wired[None])[0])


def longest_path_score(g: pd.DataFrame) -> float:
    _, a, wired = _matrix(g)
    return float(longest_path_scores(a[None], wired[None])[0])


def resistance_score(g: pd.DataFrame) -> float:
    """Effective resistances between all pairs of probes (``probe`` true at their rows) of symmetric admittances ``w``; an edge from a node to
    itself leads to ground. ``-1`` with fewer than two probes. One matrix a graph: ``resistance`` does the same over edge tables."""
    names, a, _ = _matrix(g)
    loops = np.diag(a)
    a = a - np.diag(loops)
    a = a + a.T
    own = g[g["probe"]]
    probes = sorted({names.index(x) for x in [*own["u"], *own["v"]]})
    laplacian = np.diag(a.sum(axis=1) + loops) - a
    return effective_resistance(laplacian, list(combinations(probes, 2))) if len(probes) > 1 else -1.0


def score_graphs(edges: DataFrame, score: Callable[[pd.DataFrame], float], key: str = "result_id", nudge: float = 0.0, places: int = 6) -> DataFrame:
    """``key, score`` of each result's small weighted graph, rows ``key, u, v, w``. A result's graph has as many edges as its query
    at most a few dozen, so groups are small. ``nudge`` moves scores off the ties of rounding to ``places``."""
    kind = dict(edges.dtypes)[key]

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(k, round(score(g) + nudge, places)) for k, g in rows.groupby(key, sort=False)]
        return pd.DataFrame(found, columns=[key, "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of a graph that the next batch may go on with
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows])
            last = rows[key] == rows[key].iloc[-1]
            held = rows[last]
            if not last.all():
                yield scored(rows[~last])
        if held is not None:
            yield scored(held)

    own = edges.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    return own.mapInPandas(run, f"{key} {kind}, score double")


#: Cells of the matrices that are scored together.
CELLS = 4_000_000


def _stacked(graph: np.ndarray, u: pa.Array, v: pa.Array, w: np.ndarray, n_graphs: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The score of each graph, those of one size together; an edge's graph is its number."""
    names = pa.concat_arrays([u, v]).dictionary_encode().indices.to_numpy().astype(np.int64)
    many = int(names.max(initial=0)) + 1
    nodes, at = np.unique(np.concatenate([graph, graph]) * many + names, return_inverse=True)
    size = np.bincount(nodes // many, minlength=n_graphs)
    place = at - (np.cumsum(size) - size)[np.concatenate([graph, graph])]
    a, b, out = place[: len(graph)], place[len(graph) :], np.zeros(n_graphs)
    for n in np.unique(size[size > 0]):
        same = np.flatnonzero(size == n)
        slot = np.full(n_graphs, -1)
        slot[same] = np.arange(len(same))
        mine = np.flatnonzero(slot[graph] >= 0)
        cell = (slot[graph[mine]] * n + a[mine]) * n + b[mine]
        step = max(1, CELLS // int(n * n))
        for first in range(0, len(same), step):
            last = min(len(same), first + step)
            own = (cell >= first * n * n) & (cell < last * n * n)
            at_cell, cells = cell[own] - first * n * n, (last - first) * n * n
            weights = np.bincount(at_cell, w[mine[own]], cells).reshape(-1, n, n)
            out[same[first:last]] = score(weights, (np.bincount(at_cell, minlength=cells) > 0).reshape(-1, n, n))
    return out


def score_stacked(edges: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str = "result_id", nudge: float = 0.0, places: int = 6) -> DataFrame:
    """``score_graphs`` by a score of many graphs of one size at once. Rows that lie in one partition by ``key`` aren't shuffled."""
    kind = dict(edges.dtypes)[key]
    graphs = edges.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("u", "v", "w")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            u, v, w = own.flatten().flatten()
            graph = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy())
            found = _stacked(graph, u, v, w.cast("double").to_numpy(zero_copy_only=False), len(own), score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(found + nudge, places))], names=[key, "score"])

    return graphs.mapInArrow(run, f"{key} {kind}, score double")
