"""Queries of the rankers: resistance of whole result graphs, their closure, ranks of many queries at once, filtered neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import graphs, neighbourhood, resistance, results, scoring
from kgloom.operators.checkpoints import drop, step
from kgloom.pipeline_queries import _stream
from kgloom.queries import _CHAIN, _SQL, _chains, query
from kgloom.sources import star
from kgloom.streaming import merging

# Resistance


@query(_CHAIN + """ select result_id, round(exp(-2 / sum(1 / (1 / (w1 + 0.1) + 1 / (w2 + 0.1))) - 2 / (result_id % 7 + 1)) + 1e-9, 6) as score from c group by 1""")
def q133_resistance_three_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Probes c, s and t; t hangs on s by a bridge, and a node on c leads nowhere."""
    own = _chains(spark, sf).select("result_id", "u", "v", (F.col("w") + 0.1).alias("g"))
    ids = own.select("result_id").distinct()
    tail = F.struct(F.lit("s").alias("u"), F.lit("t").alias("v"), (F.col("result_id") % 7 + 1).cast("double").alias("g"))
    more = ids.select("result_id", F.explode(F.array(tail, F.struct(F.lit("c").alias("u"), F.lit("z").alias("v"), F.lit(3.0).alias("g")))).alias("e")).select("result_id", "e.*")
    probes = ids.select("result_id", F.explode(F.array(*(F.lit(x) for x in "cst"))).alias("node"))
    return resistance.scores(own.union(more), probes).select("result_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


def _closure(spark: SparkSession, sf: str, a: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    a = a or star.analyses(spark, sf)
    aux = lambda c: F.concat(F.lit("AUX:"), c.cast("string"))
    edges = star.supplies(spark, sf).select("edge_id", "subject", "object", (F.coalesce("affinity", F.lit(0.0)) >= 0.2).alias("described"))
    supports = a.where("pos = 1 and result_id % 3 > 0").select(F.col("kedge_id").alias("edge_id"), aux(F.col("result_id") + 1).alias("aux_id"))
    aux_edges = a.select(aux(F.col("result_id")).alias("aux_id"), F.col("kedge_id").alias("edge_id"))
    aux_nodes = star.table(spark, sf, "orders").select(aux(F.col("o_orderkey")).alias("aux_id"), F.concat(F.lit("CUST:"), F.col("o_custkey").cast("string")).alias("node_id"))
    return a.select("result_id", F.col("kedge_id").alias("edge_id")), edges, supports, aux_edges, aux_nodes


@query()
def q134_result_graph_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each result's graph with all that its support graphs reach, scored between its two query nodes. Tested against matrices."""
    # numbers stand for nodes (parts even, suppliers odd, customers below 0), edges and support graphs, which are much shuffled and have no texts
    lines = star.result_lines(spark, sf).select("result_id", "pos", (2 * F.col("l_partkey")).alias("sn"), (2 * F.col("l_suppkey") + 1).alias("on_"))
    a = step(lines.groupBy("result_id").agg(F.collect_list(F.struct("pos", "sn", "on_")).alias("lines")), "analyses")
    each = a.select("result_id", F.inline("lines")).select("result_id", "pos", F.struct(F.col("on_").alias("s"), F.col("sn").alias("p")).alias("edge_id"))
    weight = scoring.admittance(F.lit(scoring.BASE_WEIGHT)) + scoring.admittance(scoring.sigmoid(F.col("n"), "unknown", "publications"))
    ends = star.supplied_pairs(spark, sf).select((2 * F.col("l_suppkey") + 1).alias("subject"), (2 * F.col("l_partkey")).alias("object"), (F.coalesce("a", F.lit(0.0)) >= 0.2).alias("described"), weight.alias("admittance"))
    edges = ends.withColumn("edge_id", F.struct(F.col("subject").alias("s"), F.col("object").alias("p")))
    supports = each.where("pos = 1 and result_id % 3 > 0").select("edge_id", (F.col("result_id") + 1).alias("aux_id"))
    aux_nodes = star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("aux_id"), (-1 - F.col("o_custkey")).alias("node_id"))
    rows, stored = graphs.ranker_rows(each.select("result_id", F.col("result_id").alias("aux_id"), "edge_id"), edges, supports, aux_nodes, ["admittance"])
    of = lambda name: F.array_distinct(F.transform("lines", lambda x: x[name]))
    bound = a.select("result_id", F.create_map(F.lit("sn"), of("sn"), F.lit("on"), of("on_")).alias("binds"))
    wired = resistance.wired(rows, bound, star.parts_for(spark, star.table(spark, sf, "lineitem").count()))
    asked = a.select("result_id", F.lit("on").alias("u"), F.lit("sn").alias("v"))
    whole = wired.unionByName(asked.withColumn("g", F.lit(scoring.QUERY_EDGE)))  # parallel edges are added
    out = resistance.scores(whole, asked.select("result_id", F.explode(F.array("u", "v")).alias("node")))
    return out.select("result_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query()
def q135_ranker_closure(spark: SparkSession, sf: str) -> DataFrame:
    a = step(star.analyses(spark, sf).select("result_id", "pos", "kedge_id"), "analyses")
    edges, nodes = graphs.ranker_closure(*_closure(spark, sf, a))
    drop(a)
    return edges.select("result_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).unionByName(nodes.select("result_id", F.lit("node").alias("kind"), F.col("node_id").alias("id")))


_SQL["q135_ranker_closure"] = star.with_views("""with e as (select edge_id, subject, object, coalesce(affinity, 0) >= 0.2 as described from kg_edges where predicate = 'supplies'),
 sup as (select distinct kedge_id as edge_id, result_id + 1 as aux from analyses where pos = 1 and result_id % 3 > 0),
 ax as (select distinct result_id as aux, kedge_id as edge_id from analyses),
 walk as (select a.result_id, a.kedge_id as edge_id from analyses a join e on e.edge_id = a.kedge_id where described
   union select w.result_id, ax.edge_id from walk w join e on e.edge_id = w.edge_id and e.described join sup on sup.edge_id = w.edge_id join ax on ax.aux = sup.aux)
 select result_id, 'edge' as kind, edge_id as id from walk union select result_id, 'edge', kedge_id from analyses
 union select result_id, 'node', unnest([subject, object]) from walk join e using (edge_id)
 union select w.result_id, 'node', 'CUST:' || cast(o_custkey as string) from walk w join e on e.edge_id = w.edge_id and e.described join sup on sup.edge_id = w.edge_id join orders on o_orderkey = sup.aux""").replace("with ", "with recursive ", 1)


# Ranks


def _ranks_sql(p: str, links: str, targets: str, steps: int) -> str:
    """Names ``<p>r<steps>`` (query, id, r) after so many steps over links (query, subject, object) with targets (query, id)."""
    each = f"""{p}n as materialized (select query, subject as id from {links} union select query, object from {links}),
 {p}d as materialized (select query, subject as id, count(*) as deg from {links} group by 1, 2),
 {p}g as materialized (select distinct t.query, t.id from {targets} t join {p}n n on n.query = t.query and n.id = t.id),
 {p}s as materialized (select n.query, count(*) as size, count(g.id) as goals from {p}n n left join {p}g g on g.query = n.query and g.id = n.id group by 1),
 {p}b as materialized (select n.query, n.id, d.deg, case when goals = 0 then 1.0 / size when g.id is not null then 1.0 / goals else 0.0 end as p, 1.0 / size as even
   from {p}n n join {p}s s on s.query = n.query left join {p}g g on g.query = n.query and g.id = n.id left join {p}d d on d.query = n.query and d.id = n.id),
 {p}r0 as materialized (select query, id, cast(even as double) as r from {p}b)"""
    for k in range(1, steps + 1):
        each += f""", {p}r{k} as materialized (select b.query, b.id, 0.85 * (coalesce(m.got, 0) + coalesce(l.lost, 0) * b.p) + 0.15 * b.p as r from {p}b b
 left join (select l.query, l.object as id, sum(r / deg) as got from {links} l join {p}d d on d.query = l.query and d.id = l.subject join {p}r{k - 1} r on r.query = l.query and r.id = l.subject group by 1, 2) m on m.query = b.query and m.id = b.id
 left join (select b.query, sum(r) as lost from {p}b b join {p}r{k - 1} r on r.query = b.query and r.id = b.id where deg is null group by 1) l on l.query = b.query)"""
    return each


STEPS = 8


@query()
def q136_personal_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking of each source's graph with its small parts as targets; the last source has none."""
    parts = star.table(spark, sf, "part").where("p_size <= 5 and p_partkey % 5 < 4")
    targets = parts.select(F.concat(F.lit("src"), (F.col("p_partkey") % 5).cast("string")).alias("query"), F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("node_id"))
    links = star.kg_edges(spark, sf).select(F.col("source").alias("query"), "subject", "object")
    return neighbourhood.personal_ranks(links, targets, tolerance=0.0, most=STEPS).select("query", "node_id", F.round("r", 9).alias("score"))


_SQL["q136_personal_ranks"] = star.with_views(f"""with t as (select 'src' || cast(p_partkey % 5 as string) as query, 'PART:' || cast(p_partkey as string) as id from part where p_size <= 5 and p_partkey % 5 < 4),
 l as materialized (select distinct source as query, subject, object from kg_edges),
 {_ranks_sql("p", "l", "t", STEPS)} select query, id as node_id, round(r, 9) as score from pr{STEPS}""")


@query()
def q138_filtered_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps from the suppliers of each nation; edges to regions and nodes of customers are the filtered ones."""
    starts = star.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("query"), F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    nodes, edges = neighbourhood.neighbourhood(star.kg_edges(spark, sf), starts, ["part_of"], "CUST:", tolerance=0.0, most=STEPS)
    each = edges.groupBy("query", "hop").agg(F.count("*").alias("n_edges"))
    return nodes.join(each, ["query", "hop"], "left").select("query", "hop", "node_id", "rank", F.round("score", 8).alias("score"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def _hop_sql(hop: int, frontier: str) -> str:
    p = f"h{hop}"
    return f"""{p}e as materialized (select distinct f.query, edge_id, subject, object from kg_edges e join {frontier} f on f.id = e.subject or f.id = e.object
   where predicate <> 'part_of' and not (subject like 'CUST:%' and object like 'CUST:%')),
 {p}l as materialized (select distinct query, subject, object from {p}e),
 {_ranks_sql(p, p + "l", frontier, STEPS)},
 {p}t as materialized (select * from (select query, id, r, row_number() over (partition by query order by round(r, 12) desc, id) as rank from {p}r{STEPS} where id not like 'CUST:%') where rank <= 15),
 {p}k as materialized (select query, count(*) as n_edges from {p}e e where exists (select 1 from {p}t t where t.query = e.query and t.r > 0 and t.id in (e.subject, e.object)) group by 1)"""


_SQL["q138_filtered_neighbourhood"] = star.with_views(f"""with f1 as materialized (select distinct cast(s_nationkey as bigint) as query, 'SUPP:' || cast(s_suppkey as string) as id from supplier),
 {_hop_sql(1, "f1")}, f2 as materialized (select query, id from h1t except select query, id from f1), {_hop_sql(2, "f2")}
 select t.query, hop, id as node_id, cast(rank as integer) as rank, round(r, 8) as score, coalesce(n_edges, 0) as n_edges
 from (select 1 as hop, t.*, n_edges from h1t t left join h1k k on k.query = t.query union all select 2, t.*, n_edges from h2t t left join h2k k on k.query = t.query) t""")


@query()
def q137_promiscuous_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Results left when each part with over 25 results takes them away, the most frequent first. Tested one removal at a time."""
    return results.without_promiscuous_multi(star.analyses(spark, sf).select("result_id", F.col("sn").alias("knode")), 25)


# Merge under state


@query("""with c as (select l_suppkey as r, cast(l_orderkey as varchar) as callback, l_orderkey % 250 as s, cast(l_partkey % 10 as varchar) as answer, 'sup|' || l_suppkey || '|' || l_partkey as e, cast(l_discount as double) as score from lineitem),
 n as (select r, count(distinct callback) filter (s <= 210) as returned from c group by r)
 select r as response_id, case when r % 2 = 0 then 'complete' else 'timeout' end as outcome, any_value(returned) as returned, answer, array_to_string(list_sort(list_distinct(list(e))), ',') as edges, max(score) as score, arg_min(e, (s, callback, e)) as first_edge
 from c join n using (r) where s <= 210 group by r, answer""")
def q139_serial_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A response for each supplier and a callback for each order; every other response awaits one callback that never comes."""
    start = F.lit(1_700_000_000) + F.col("l_suppkey") * 60
    in_time = F.when(F.col("l_orderkey") % 250 <= 210, F.col("l_orderkey"))
    expected = star.table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count_distinct(in_time) + F.col("l_suppkey") % 2).alias("expected"))
    own = _stream(spark, sf, "lineitem").join(expected, "l_suppkey").select(
        F.col("l_suppkey").cast("long").alias("response_id"), "l_linenumber", F.col("l_orderkey").cast("string").alias("callback_id"), F.timestamp_seconds(start).alias("sent_at"), "expected",
        F.timestamp_seconds(start + F.col("l_orderkey") % 250).alias("ts"), (F.col("l_partkey") % 10).cast("string").alias("answer"), F.concat_ws("|", F.lit("sup"), "l_suppkey", "l_partkey").alias("kedge_id"), F.col("l_discount").cast("double").alias("score"),
    )
    # first lines tick far ahead, so that the last timers fire; ticks are spread over as many keys as there are responses
    far = F.timestamp_seconds(F.lit(4_000_000_000))
    ticks = own.where("l_linenumber = 1").withColumns({"response_id": -1 - F.col("response_id"), "callback_id": F.lit("tick"), "sent_at": far, "ts": far})
    found = merging.gathered(merging.serial_merge(own.union(ticks)), "serial").where("response_id >= 0")
    return found.withColumn("edges", F.concat_ws(",", "edges"))
