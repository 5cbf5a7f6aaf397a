"""Filters, merges, sorting and limits over results, analyses and bindings in rows.

Bindings are rows ``result_id, qnode, knode``; edge bindings ``result_id, kedge_id``; analyses ``result_id, pos, score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import drop, step


def node_sets(bindings: DataFrame) -> DataFrame:
    """``result_id, qnode, knodes``: the set a query node binds, sorted."""
    return bindings.groupBy("result_id", "qnode").agg(F.array_sort(F.collect_set("knode")).alias("knodes"))


def with_unique_nodes(bindings: DataFrame) -> DataFrame:
    """``result_id`` of results no two of whose query nodes bind the same set."""
    own = node_sets(bindings).groupBy("result_id").agg(F.count("*").alias("n"), F.count_distinct("knodes").alias("d"))
    return own.where("n = d").select("result_id")


def without_promiscuous(bindings: DataFrame, most: int = 10) -> DataFrame:
    """``result_id`` left when each result binds one node and those of nodes with over ``most`` results go; nothing goes
    below ``most`` results."""
    per_node = bindings.groupBy("knode").agg(F.count("*").alias("n"))
    total = bindings.agg(F.count("*").alias("total"))
    kept = bindings.join(per_node, "knode").join(F.broadcast(total))  # one row
    return kept.where((F.col("n") <= most) | (F.col("total") < most)).select("result_id")


#: Bindings that one task removes by itself, counted first; more are removed in rounds of joins.
FEW = 200_000
#: Nodes that go to all tasks, counted first.
FEW_NODES = 500_000
#: A phase takes up the most frequent nodes with this share of the bindings of nodes that may go.
SHARE = 0.2


def without_promiscuous_multi(bindings: DataFrame, most: int = 10, hot: int = 1000) -> DataFrame:
    """The same for results that bind several nodes: the most frequent node's results go, again and again, while it has over
    ``most``. Of equally frequent nodes the one that the first of the results left binds goes first, then the smaller.

    A phase removes in that order down to nodes with ``least`` results, for which only nodes count that have so many at its start: counts never
    grow, so rarer nodes come after them. Nodes with ``most`` or fewer never go, so their bindings are left out once they are many. Nodes
    with more than one in ``hot`` of the bindings are looked up by broadcast; there are fewer than ``hot``.
    """
    whole = step(bindings.select("result_id", "knode").distinct(), "bindings")
    left, gone = whole, []
    while True:
        named = left.where("result_id is not null and knode is not null")
        heavy = step(named.groupBy("knode").agg(F.count("*").alias("n")).where(F.col("n") > most), "heavy")
        levels = sorted((tuple(r) for r in heavy.groupBy("n").agg(F.count("*")).collect()), reverse=True)  # at most the root of twice the bindings
        if not levels:
            break
        total, least, n_nodes, taken = sum(n * nodes for n, nodes in levels), levels[0][0], 0, 0
        for n, nodes in levels:
            taken += n * nodes
            if n_nodes and taken > max(SHARE * total, FEW):
                break
            least, n_nodes = n, n_nodes + nodes
        else:
            least = most + 1
        some = _at_nodes(named, heavy.where(F.col("n") >= least), n_nodes, total, hot)
        nodes = _gone_nodes(some.groupBy("result_id").agg(F.collect_list("knode").alias("knodes")), least, total, hot)
        gone.append(step(_at_nodes(named, nodes, nodes.count(), total, hot).select("result_id").distinct(), "gone"))
        if least == most + 1:
            break
        n_heavy = sum(nodes for _, nodes in levels)
        own = _at_nodes(named, heavy, n_heavy, total, hot) if total < 0.75 * left.count() else named
        new = step(own.select("result_id", "knode").join(gone[-1], "result_id", "left_anti"), "bindings")
        drop(heavy, *([] if left is whole else [left]))
        left = new
    drop(heavy, *([] if left is whole else [left]))
    out = whole.select("result_id").distinct()
    return out.join(reduce(DataFrame.unionByName, gone), "result_id", "left_anti") if gone else out


def _at_nodes(rows: DataFrame, nodes: DataFrame, n_nodes: int, total: int, hot: int) -> DataFrame:
    """``rows`` (with ``knode``) joined with ``nodes`` (``knode, n``), of which there are ``n_nodes``, without a task that gets a hot one's rows."""
    rows = rows.drop("n") if "n" in rows.columns else rows
    if n_nodes <= FEW_NODES:
        return rows.join(F.broadcast(nodes), "knode")
    often = nodes.where(F.col("n") * hot > total)
    rest = rows.join(F.broadcast(often.select("knode")), "knode", "left_anti").join(nodes.where(F.col("n") * hot <= total), "knode")
    return rows.join(F.broadcast(often), "knode").unionByName(rest)


def _folded(each: DataFrame, alone: DataFrame | None) -> DataFrame:
    """``result_id, knode, times, first`` of results and their nodes (``result_id, knodes``): a row a binding of results with several nodes, and
    a row a node, without a result, for all results that have no other node, ``alone`` among them."""
    single = each.where(F.size("knodes") == 1).select(F.get("knodes", F.lit(0)).alias("knode"), F.lit(1).cast("long").alias("times"), F.col("result_id").alias("first"))
    single = single if alone is None else single.unionByName(alone.select("knode", "times", "first"))
    none = F.lit(None).cast(dict(each.dtypes)["result_id"]).alias("result_id")
    many = each.where(F.size("knodes") > 1).select("result_id", F.explode("knodes").alias("knode"), F.lit(1).cast("long").alias("times"), F.col("result_id").alias("first"))
    return many.unionByName(single.groupBy("knode").agg(F.sum("times").alias("times"), F.min("first").alias("first")).select(none, "knode", "times", "first"))


def _gone_nodes(each: DataFrame, least: int, total: int, hot: int) -> DataFrame:
    """``knode, n`` of the nodes that go while one has ``least`` results or more, of results with their nodes (``result_id, knodes``).

    A round removes the results of every node that comes before all nodes it shares a result with. Removals elsewhere never
    change those results nor let such a neighbour pass, so the rounds end with what one removal at a time leaves.
    """
    left, gone = step(_folded(each, None), "contested"), []
    kind = dict(left.dtypes)["knode"]
    while left.count() > FEW:
        often = step(left.groupBy("knode").agg(F.sum("times").alias("n"), F.min("first").alias("earliest")).where(F.col("n") >= least), "often")
        n_nodes = often.count()
        own = _at_nodes(left, often, n_nodes, total, hot)
        before = F.struct((-F.col("n")).alias("n"), F.col("earliest"), F.col("knode"))
        tops = step(own.where("result_id is not null").groupBy("result_id").agg(F.min(before).alias("top"), F.collect_list("knode").alias("knodes")), "tops")
        alone = own.where("result_id is null").select("knode", "n", "times", "first")
        led = tops.select("top.knode", (-F.col("top.n")).alias("n"), F.lit(1).cast("long").alias("times")).unionByName(alone.select("knode", "n", "times"))
        leads = step(led.groupBy("knode").agg(F.first("n").alias("n"), F.sum("times").alias("led")).where("led = n").select("knode", "n"), "leads")
        names = leads.select("knode")
        names = F.broadcast(names) if leads.count() <= FEW_NODES else names
        rest = tops.withColumn("knode", F.col("top.knode")).join(names, "knode", "left_anti").select("result_id", "knodes")
        new = step(_folded(rest, alone.join(names, "knode", "left_anti")), "contested")
        gone.append(leads)
        drop(left, often, tops)
        left = new
    own = left.coalesce(1)
    gone.append(step(own.mapInArrow(lambda batches: _removed(batches, least), f"knode {kind}, n long"), "leads"))
    drop(left)
    return reduce(DataFrame.unionByName, gone)


def _removed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rounds of ``_gone_nodes`` over all batches (``_folded``)."""
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    alone, times = rows.column("result_id").is_null().to_numpy(), rows.column("times").to_numpy()
    _, at, k = np.unique(rows.column("knode").to_numpy(), return_index=True, return_inverse=True)
    _, r = np.unique(rows.column("first").to_numpy(), return_inverse=True)
    n_nodes, n_results = len(at), int(r.max(initial=0)) + 1
    single, since = np.bincount(k[alone], times[alone], n_nodes).astype(np.int64), np.full(n_nodes, n_results)
    np.minimum.at(since, k[alone], r[alone])
    r, k, gone = r[~alone], k[~alone], np.zeros(n_nodes, np.int64)
    while True:
        n, first = single + np.bincount(k, minlength=n_nodes), since.copy()
        np.minimum.at(first, k, r)
        often = n >= least
        if not often.any():
            break
        place, top = np.empty(n_nodes, np.int64), np.full(n_results, n_nodes)
        place[np.lexsort((np.arange(n_nodes), first, -n))] = np.arange(n_nodes)
        r, k = r[often[k]], k[often[k]]
        np.minimum.at(top, r, place[k])
        lead = often & (single + np.bincount(k[place[k] == top[r]], minlength=n_nodes) == n)
        gone[lead], single[lead | ~often] = n[lead], 0
        out = np.zeros(n_results, bool)
        out[r[lead[k]]] = True
        r, k = r[~out[r]], k[~out[r]]
    found = np.flatnonzero(gone)
    yield pa.RecordBatch.from_arrays([rows.column("knode").take(pa.array(at[found])).combine_chunks(), pa.array(gone[found])], names=["knode", "n"])


def promiscuous_qnodes(qedges: DataFrame) -> DataFrame:
    """``query_id, qnode`` shared as subject, or as object, by two edges with equal predicates and qualifiers, in queries of
    three edges or more. ``qedges``: query_id, pos, subject, object, predicates, qualifiers."""
    large = qedges.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 3").select("query_id")
    own = qedges.join(large, "query_id", "left_semi")
    a, b = own.alias("a"), own.alias("b")
    same = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.pos") < F.col("b.pos")) & F.col("a.predicates").eqNullSafe(F.col("b.predicates")) & F.col("a.qualifiers").eqNullSafe(F.col("b.qualifiers"))
    parts = [a.join(b, same & (F.col(f"a.{end}") == F.col(f"b.{end}"))).select(F.col("a.query_id").alias("query_id"), F.col(f"a.{end}").alias("qnode")) for end in ("subject", "object")]
    return parts[0].union(parts[1]).distinct()


def edge_sets(edge_bindings: DataFrame) -> DataFrame:
    """``result_id, edge_set``: all bound edges, sorted, as one string."""
    return edge_bindings.groupBy("result_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("kedge_id"))).alias("edge_set"))


def new_creatives(creative: DataFrame, lookup: DataFrame, pos: Column) -> DataFrame:
    """Creative results whose edge set no lookup result and no earlier creative one has."""
    fresh = creative.join(lookup.select("edge_set").distinct(), "edge_set", "left_anti")
    first = F.row_number().over(W.partitionBy("edge_set").orderBy(pos))
    return fresh.withColumn("_n", first).where("_n = 1").drop("_n")


def sorted_results(analyses: DataFrame, ascending: bool = False) -> DataFrame:
    """``result_id, max_score, rank``: results by their best analysis (none: 0), stable by ``result_id``."""
    best = analyses.groupBy("result_id").agg(F.coalesce(F.max(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("max_score"))
    order = F.col("max_score").asc() if ascending else F.col("max_score").desc()
    return best.orderBy(order, "result_id")


def top_results(analyses: DataFrame, n: int = 500) -> DataFrame:
    return sorted_results(analyses).limit(n)


def top_analyses(analyses: DataFrame, n: int = 500) -> DataFrame:
    """Each result's first ``n`` analyses by score, stable by position."""
    order = W.partitionBy("result_id").orderBy(F.col("score").desc(), "pos")
    return analyses.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def merged_by_answer(analyses: DataFrame) -> DataFrame:
    """A row for each answer (the bound query-side node): its results, analyses, distinct edges and best score."""
    return analyses.groupBy("on_").agg(F.count_distinct("result_id").alias("n_results"), F.count("*").alias("n_analyses"), F.count_distinct("kedge_id").alias("n_edges"), F.max("score").alias("best_score"))


def merged_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of two graphs by id: the later non-empty name, the union of categories and of attributes."""
    x = a.select("node_id", F.col("name").alias("name_a"), F.col("categories").alias("cat_a"))
    y = b.select("node_id", F.col("name").alias("name_b"), F.col("categories").alias("cat_b"))
    empty = F.array().cast("array<string>")
    joined = x.join(y, "node_id", "full_outer")
    name = F.coalesce(F.nullif("name_b", F.lit("")), F.nullif("name_a", F.lit("")))
    return joined.select("node_id", name.alias("name"), F.array_sort(F.array_union(F.coalesce("cat_a", empty), F.coalesce("cat_b", empty))).alias("categories"))


def merged_edges(a: DataFrame, b: DataFrame, aggregator: str) -> DataFrame:
    """Edges of two graphs by id: the union of sources; the aggregator is added where an edge is first adopted from ``b``."""
    x, y = a.select("edge_id", F.col("sources").alias("s_a")), b.select("edge_id", F.col("sources").alias("s_b"))
    empty = F.array().cast("array<string>")
    adopted = F.when(F.col("s_a").isNull() & (F.size("s_b") > 0), F.array_union("s_b", F.array(F.lit(aggregator)))).otherwise(F.array_union(F.coalesce("s_a", empty), F.coalesce("s_b", empty)))
    return x.join(y, "edge_id", "full_outer").select("edge_id", F.array_sort(adopted).alias("sources"))


def combined_unique(a: Column, b: Column) -> Column:
    """The distinct elements of two arrays in order of first appearance."""
    return F.array_distinct(F.concat(a, b))


def unified_aux(a: DataFrame, b: DataFrame) -> DataFrame:
    """``aux_id, edges`` of both sides, the edges of an id united."""
    return a.union(b).select("aux_id", F.explode("edges").alias("e")).groupBy("aux_id").agg(F.array_sort(F.collect_set("e")).alias("edges"))
