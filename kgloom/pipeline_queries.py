"""More queries over the same tables: message intake and logs, query plans as tables, result graphs, the overlay as a whole, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.operators import graphs, monitor, overlay, pathfinder, response, results, scoring
from kgloom.plans import tables
from kgloom.queries import query
from kgloom.sources import star
from kgloom.streaming import monitor as streams

# State and logs


@query("""select stream, bucket, name, value from (
 select event_type as stream, date_trunc('day', ts) as bucket, cast(count(*) as double) as xlen, cast(count(distinct user_id) as double) as consumers, max(value) as peak from events group by 1, 2)
 unpivot (value for name in (xlen, consumers, peak))""")
def q75_unpivot_history(spark: SparkSession, sf: str) -> DataFrame:
    daily = star.table(spark, sf, "events").groupBy(F.col("event_type").alias("stream"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").cast("double").alias("xlen"), F.count_distinct("user_id").cast("double").alias("consumers"), F.max("value").alias("peak"))
    return daily.unpivot(["stream", "bucket"], ["xlen", "consumers", "peak"], "name", "value")


@query("""with d as (select cast(l_orderkey as varchar) as qid, max(l_shipdate) as stop_time from lineitem group by 1)
 select q.qid, case when d.qid is not null and q.state = 'QUEUED' then 'COMPLETED' else q.state end as state,
  case when d.qid is not null and q.state = 'QUEUED' then d.stop_time end as stop_time from query_state q left join d on q.qid = d.qid""")
def q76_query_state_ops(spark: SparkSession, sf: str) -> DataFrame:
    done = star.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("qid")).agg(F.max("l_shipdate").alias("stop_time"))
    return response.completed(star.query_state(spark, sf), done).select("qid", "state", "stop_time")


@query("""select user_id, array_to_string(list(event_type order by ts, event_id), '>') as log from events group by 1""")
def q77_log_append(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "events").withColumnRenamed("event_type", "entry")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return response.logs(old.union(new), "user_id").select("user_id", F.concat_ws(">", "log").alias("log"))


@query("""with e as (select event_type as stream, count(*) as backlog, max(value) as peak from events group by 1),
 w as (select event_type as stream, count(distinct user_id) as workers from events where value > 40 group by 1), t as (select sum(value) as used from events)
 select e.stream, backlog, peak, coalesce(workers, 0) as workers, round(100 * used / 1e9 + 1e-9, 2) as disk_used_pct,
  case when coalesce(workers, 0) = 0 then 'critical' else 'info' end as severity from e left join w using (stream) cross join t""")
def q79_snapshot_join(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "events").withColumnRenamed("event_type", "stream")
    backlog = e.groupBy("stream").agg(F.count("*").alias("backlog"), F.max("value").alias("peak"))
    workers = e.where("value > 40").groupBy("stream").agg(F.count_distinct("user_id").alias("workers"))
    used = e.agg(F.sum("value").alias("used"))
    return monitor.snapshot(backlog, workers, used, 1e9)


@query("""with p as (select event_type as stream, date_trunc('hour', ts) as bucket, count(*) as n, max(value) as y from events group by 1, 2),
 s as (select stream, sum(n) as total, max(y) as top from p group by 1 having max(y) > 0), r as (select min(epoch(ts)) as since, greatest(60, max(epoch(ts)) - min(epoch(ts))) as span from events)
 select p.stream, p.bucket, cast(total as bigint) as total, round((epoch(p.bucket) - since) / span * 100 + 1e-9, 4) as position,
  case when y / top < 0.3 then 'low' when y / top < 0.8 then 'busy' else 'full' end as class from p join s using (stream) cross join r""")
def q80_dashboard_filters(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "events").withColumnRenamed("event_type", "stream")
    return monitor.dashboard(e).withColumn("position", F.round(F.col("position") + 1e-9, 4))


@query("""select edge_id, num_publications % 3 = 0 as supported, case when num_publications % 4 = 0 then 0.9 else coalesce(p_value, 0.5) end as confidence from kg_edges""")
def q82_support_flags(spark: SparkSession, sf: str) -> DataFrame:
    e = star.kg_edges(spark, sf)
    none = F.lit(None).cast("struct<name:string,value:string>")
    given = F.filter(F.array(F.when(F.col("num_publications") % 3 == 0, F.struct(F.lit("biolink:support_graphs").alias("name"), F.lit("AUX:1").alias("value"))).otherwise(none), F.when(F.col("num_publications") % 4 == 0, F.struct(F.lit("biolink:agent_type").alias("name"), F.lit("manual_agent").alias("value"))).otherwise(none)), lambda x: x.isNotNull())
    return e.select("edge_id", response.is_supported(given).alias("supported"), response.manual_override(given, F.coalesce("p_value", F.lit(0.5))).alias("confidence"))


# Query plans as tables: a query an order; its first line pins a part, its priority names the predicate

_QUERIES = """select cast(o_orderkey as varchar) as query_id, substr(o_orderpriority, 1, 1) as k, o_custkey from orders"""


def _query_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``query_id, subject_ids, object_ids, predicate, aspect, direction, inferred`` of one-edge queries."""
    k = F.substring("o_orderpriority", 1, 1).cast("int")
    pin = F.array(F.concat(F.lit("CUST:"), F.col("o_custkey").cast("string")))
    none = F.array().cast("array<string>")
    return star.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.when(k % 2 == 0, pin).otherwise(none).alias("subject_ids"), F.when(k % 2 == 1, pin).otherwise(none).alias("object_ids"), F.when(k < 4, "treats").otherwise("affects").alias("predicate"), F.when(k > 3, "activity").alias("aspect"), F.when(k == 5, "increased").alias("direction"), (k != 3).alias("inferred"))


@query(f"""with q as ({_QUERIES}) select query_id, k <> '3' as infer, case when k = '3' then null when cast(k as int) % 2 = 0 then 'subject' else 'object' end as question,
 case when k = '3' then null when cast(k as int) % 2 = 0 then 'object' else 'subject' end as answer, case when k <> '3' then 'CUST:' || o_custkey end as pinned from q""")
def q122_examine_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return tables.examined(_query_edges(spark, sf))


_KEY = """case k when '4' then '{"object_aspect_qualifier": "activity", "predicate": "affects"}'
  when '5' then '{"object_aspect_qualifier": "activity", "object_direction_qualifier": "increased", "predicate": "affects"}' else '{"predicate": "treats"}' end"""


@query(f"with q as ({_QUERIES}) select query_id, {_KEY} as rule_key from q")
def q123_rule_key(spark: SparkSession, sf: str) -> DataFrame:
    return _query_edges(spark, sf).select("query_id", tables.rule_key().alias("rule_key"))


_RULES = [("treats", None, None, "$source treats_by $target"), ("treats", None, None, "$source -> g -> $target"), ("affects", "activity", "increased", "$source up $target")]


@query(f"""with q as ({_QUERIES}), e as (select query_id, k, case when cast(k as int) % 2 = 0 then 'CUST:' || o_custkey else '' end as s, case when cast(k as int) % 2 = 1 then 'CUST:' || o_custkey else '' end as o from q where k <> '3'),
 r(ks, n, t) as (values ('12', 1, '$source treats_by $target'), ('12', 2, '$source -> g -> $target'), ('5', 1, '$source up $target'))
 select query_id, cast(0 as int) as n, s || ' direct ' || o as text from e union all
 select query_id, r.n, replace(replace(t, '$source', s), '$target', o) from e join r on contains(ks, k)""")
def q124_rule_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(*r[:3], n, r[3]) for r, n in zip(_RULES, (1, 2, 1), strict=True)], "predicate string, aspect string, direction string, n int, template string")
    return tables.expanded(_query_edges(spark, sf).where("inferred"), rules)


@query(f"""with q as ({_QUERIES}), g(name, preds, quals) as (values ('treating', ['treats', 'ameliorates'], ''), ('raising', ['affects', 'regulates'], 'increased'), ('plain', ['affects'], '')),
 e as (select query_id, k, case when cast(k as int) < 4 then 'treats' else 'affects' end as p, case when k = '5' then 'increased' else '' end as d from q where k <> '3')
 select query_id, name from e join g on list_contains(preds, p) and quals = d""")
def q125_template_expansion(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.createDataFrame([("treating", ["treats", "ameliorates"], []), ("raising", ["affects", "regulates"], ["increased"]), ("plain", ["affects"], [])], "name string, predicates array<string>, qualifiers array<string>")
    return tables.matched_groups(_query_edges(spark, sf).where("inferred"), groups).select("query_id", "name")


@query(f"""with q as ({_QUERIES}), t as (select *, {_KEY} || case when cast(k as int) % 2 = 0 then 's' else 'o' end || o_custkey || case when k = '3' then 'l' else 'i' end as text from q)
 select query_id, min(query_id) over (partition by text) as same_as from t""")
def q45_query_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = _query_edges(spark, sf)
    text = F.concat(tables.canonical(), F.when(F.col("inferred"), "i").otherwise("l"))
    # queries of one text are counted by their least id first, so that a common text is no hot group
    first = e.groupBy(text.alias("text")).agg(F.min("query_id").alias("same_as"))
    return e.withColumn("text", text).join(first, "text").select("query_id", "same_as")


@query(f"""with q as ({_QUERIES}) select query_id, unnest(case when k = '3' then ['lookup', 'score', 'filter'] else ['lookup', 'merge', 'score', 'filter'] end) as op,
 unnest(range(case when k = '3' then 3 else 4 end)) as step from q""")
def q47_workflow_route(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.when(F.col("inferred"), F.array(*map(F.lit, ("lookup", "merge", "score", "filter")))).otherwise(F.array(*map(F.lit, ("lookup", "score", "filter"))))
    return tables.routed(_query_edges(spark, sf).select("query_id", steps.alias("workflow")))


# Result graphs

_RGRAPH = """with e as (select result_id, 'P' || sn as u, 'S' || on_ as v, pos from analyses union all select result_id, 'C', 'P' || sn, pos from analyses)"""


@query(_RGRAPH + """, d as (select result_id, n, count(*) as degree from (select distinct result_id, u, v from e), unnest([u, v]) t(n) group by 1, 2),
 r as (select result_id, n, degree, dense_rank() over (partition by result_id order by degree) as k from d),
 c as (select result_id, k, sum(count(*)) over (partition by result_id order by k) as upto from r group by 1, 2),
 f as (select result_id, min(k) as k from c where upto > 1 group by 1)
 select r.result_id, n as node, degree from r join f on r.result_id = f.result_id and r.k <= f.k""")
def q37_probes(spark: SparkSession, sf: str) -> DataFrame:
    return response.probes(_result_edges(spark, sf))


def _result_edges(spark: SparkSession, sf: str) -> DataFrame:
    a = star.analyses(spark, sf)
    part, supplier = F.concat(F.lit("P"), F.col("sn")), F.concat(F.lit("S"), F.col("on_"))
    return a.select("result_id", part.alias("u"), supplier.alias("v")).union(a.select("result_id", F.lit("C"), part))


@query("""with a as (select distinct result_id, pos, kedge_id from analyses), m as (select result_id, qnode, knode from (select result_id, 'sn' as qnode, sn as knode from analyses union select result_id, 'on', on_ from analyses))
 select distinct a.result_id, a.pos, s.qnode as subject_q, o.qnode as object_q, a.kedge_id from a join kg_edges e on e.edge_id = a.kedge_id
 join m s on s.result_id = a.result_id and s.knode = e.subject join m o on o.result_id = a.result_id and o.knode = e.object""")
def q91_rnode_expansion(spark: SparkSession, sf: str) -> DataFrame:
    a = star.analyses(spark, sf)
    bindings = a.select("result_id", F.explode(F.create_map(F.lit("sn"), "sn", F.lit("on"), "on_")).alias("qnode", "knode"))
    parts = star.parts_for(spark, star.table(spark, sf, "lineitem").count())  # from the files' footers
    return response.result_graph(a.select("result_id", "pos", "kedge_id"), bindings, star.supplies(spark, sf), parts).select("result_id", "pos", "subject_q", "object_q", "kedge_id")


@query("""with g as (select result_id, sn, on_, avg(coalesce(p_value, 0.0)) as w from analyses a left join kg_edges e on e.edge_id = a.kedge_id group by 1, 2, 3)
 select result_id, sn as subject, on_ as object, round(w + 1e-9, 6) as w from g""")
def q108_query_graph_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = star.supplies(spark, sf).select(F.col("edge_id").alias("kedge_id"), "p_value")
    own = star.analyses(spark, sf).join(e, "kedge_id", "left").groupBy("result_id", F.col("sn").alias("subject"), F.col("on_").alias("object"))
    return own.agg(F.round(F.avg(F.coalesce("p_value", F.lit(0.0))) + 1e-9, 6).alias("w"))


@query("select result_id, max(score) as best from analyses group by 1 order by 2, 1")
def q102_rank_ascending(spark: SparkSession, sf: str) -> DataFrame:
    return results.sorted_results(star.analyses(spark, sf), ascending=True).select("result_id", F.col("max_score").alias("best"))


@query("select result_id, score as first_score from analyses where pos = 1 order by 2 desc, 1")
def q103_first_analysis_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Results by the score of their first analysis."""
    return star.analyses(spark, sf).groupBy("result_id").agg(F.min_by("score", "pos").alias("first_score")).orderBy(F.desc("first_score"), "result_id")


_ANSWERS = """with a as (select on_, result_id, pos, sn, kedge_id, result_id % 2 = 0 as creative from analyses)"""


@query(_ANSWERS + """, n as (select on_, sn, min(case when creative then 0 else 1 end) as tag, min(case when creative then result_id else result_id + 1000000000 end) as first from a group by 1, 2),
 x as (select on_, count(*) as n_nodes, string_agg(sn, ',' order by tag, first, sn) as nodes from n group by 1),
 c as (select on_, count(distinct result_id) filter (creative) as n_aux, count(distinct kedge_id) filter (not creative) as n_lookup_edges, bool_or(creative) as synthetic from a group by 1)
 select x.on_ as answer, n_nodes, md5(nodes) as nodes_md5, n_aux, n_lookup_edges, case when synthetic then 'treats|' || x.on_ end as synthetic_edge from x join c on x.on_ = c.on_""")
def q04b_merge_answers_full(spark: SparkSession, sf: str) -> DataFrame:
    a = star.analyses(spark, sf).withColumn("creative", F.col("result_id") % 2 == 0)
    return response.merged_answers(a, "treats").select("answer", F.size("nodes").cast("long").alias("n_nodes"), F.md5(F.concat_ws(",", "nodes")).alias("nodes_md5"), F.size("aux_ids").cast("long").alias("n_aux"), F.size("lookup_edges").cast("long").alias("n_lookup_edges"), "synthetic_edge")


# Overlay

_AFF = "(-1 + 2 / (1 + exp(-0.4 * affinity)))"


@query(f"""select edge_id, round({_AFF} + 1e-9, 6) as affinity from kg_edges where affinity is not null""")
def q118_affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Affinities count; a confidence score is read but has no weight."""
    e = star.kg_edges(spark, sf).where("affinity is not null")
    return e.select("edge_id", F.round(scoring.sigmoid(F.col("affinity"), "unknown", "affinity") + 1e-9, 6).alias("affinity"))


@query("""with s(source, id, base, w, lo, mid, rate) as (values ('src1', 'infores:gwas-catalog', 0.03, 1, 0, 0.05, -150), ('src2', 'infores:icees-kg', 0.03, 1, 0, 0.05, -150), ('src3', 'infores:drugcentral', 0.05, 0, 0, 0, 0))
 select edge_id, coalesce(s.base, 0.01) as base, round(case when w = 1 and p_value is not null then lo + (1 - lo) / (1 + exp(-rate * (p_value - mid))) else 0 end + 1e-9, 6) as p_weight from kg_edges e left join s on s.source = e.source""")
def q119_profiles(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in {"src1": "infores:gwas-catalog", "src2": "infores:icees-kg", "src3": "infores:drugcentral"}.items() for x in kv))
    e = star.kg_edges(spark, sf).withColumn("source", F.coalesce(names[F.col("source")], F.col("source")))
    return scoring.profiled(e, "p_value").select("edge_id", "base", F.round(F.col("weight") + 1e-9, 6).alias("p_weight"))


@query("""with v as (select event_id, ['probability', 'jaccard_index', 'pValue', 'feature_coefficient', 'CMAP similarity score', 'fisher_exact_test_p-value', 'unheard of'][event_id % 7 + 1] as name,
  case when event_id % 11 = 0 then null when event_id % 13 = 0 then null else round(value / 1000, 6) end as x, m from events, (select round(max(value) / 1000, 6) as m from events))
 select event_id, name, round(case when name = 'unheard of' then -1 when x is null then 0 when name = 'probability' then 1 / (1 + exp(-20 * (x - 0.8))) when name = 'jaccard_index' then x / m
  when name = 'pValue' then case when x <= 0 then 1 else 1 / (1 + exp(-0.849 * (-ln(x) - 4.97))) end when name = 'feature_coefficient' then case when x = 0 then 0 else 1 / (1 + exp(-2.75 * (ln(abs(x)) - 0.15))) end
  when name = 'CMAP similarity score' then abs(x / 100) else case when x <= 2.220446049250313e-16 then 1 else 1 / (1 + exp(-3 * (-ln(x) - 2.7))) end end + 1e-9, 6) as score from v""")
def q120_normalize_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    e = star.table(spark, sf, "events")
    names = F.array(*map(F.lit, ("probability", "jaccard_index", "pValue", "feature_coefficient", "CMAP similarity score", "fisher_exact_test_p-value", "unheard of")))
    value = F.round(F.col("value") / 1000, 6)
    text = F.when(F.col("event_id") % 11 == 0, "no value!").when(F.col("event_id") % 13 == 0, "nan").otherwise(value.cast("string"))
    most = e.agg(F.max(value).alias("most"))
    own = e.select("event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("name"), text.alias("text")).join(F.broadcast(most))  # one row
    return own.select("event_id", "name", F.round(scoring.dispatched(F.col("name"), F.col("text"), F.col("most")) + 1e-9, 6).alias("score"))


@query("""with p as (select result_id, least(a.sn, b.sn) as a, greatest(a.sn, b.sn) as b from analyses a join analyses b using (result_id) where a.sn < b.sn group by 1, 2, 3),
 s as (select a, b, count(*) as shared from p group by 1, 2), c as (select sn, count(distinct result_id) as n from analyses group by 1)
 select p.result_id, p.a, p.b, shared, x.n as n_a, y.n as n_b, 'omnicorp|' || p.a || '|' || p.b as edge_id, 'OMNICORP_support_graph_' || p.result_id as aux_id
 from p join s on s.a = p.a and s.b = p.b join c x on x.sn = p.a join c y on y.sn = p.b""")
def q114_overlay_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    members = star.analyses(spark, sf).select("result_id", F.col("sn").alias("node_id"))
    return overlay.overlaid(members, most=None)


# Paths and sets

@query("""with b as (select subject as a, object as b, predicate as p from kg_edges union select object, subject, predicate || ' (inverse)' from kg_edges),
 s as (select a, b, array_to_string(list_sort(list(distinct p)), ' or ') as says from b group by 1, 2)
 select x.b as n1, y.b as n2, n0.name || ' -' || x.says || '-> ' || n1.name || ' -' || y.says || '-> ' || n2.name || ' -' || z.says || '-> ' || n3.name as text
 from s x join s y on y.a = x.b join s z on z.a = y.b join kg_nodes n0 on n0.node_id = x.a join kg_nodes n1 on n1.node_id = x.b join kg_nodes n2 on n2.node_id = y.b join kg_nodes n3 on n3.node_id = z.b
 where x.a = 'PART:7' and z.b = 'REGION:1' and x.b not in ('PART:7', 'REGION:1') and y.b not in ('PART:7', 'REGION:1')""")
def q50_linearized_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of four nodes between two pinned ones, as text."""
    return pathfinder.linearized(star.kg_edges(spark, sf), star.kg_nodes(spark, sf), "PART:7", "REGION:1")


@query("""with p as (select result_id, 'PATH:' || md5(array_to_string(list_sort(list(distinct kedge_id)), ',')) as aux_id, max(score) as score from analyses group by 1),
 d as (select aux_id, count(*) as n, max(score) as score from p group by 1)
 select aux_id, n, score, row_number() over (order by score desc, aux_id) as rank from d""")
def q113_pathfinder_merge(spark: SparkSession, sf: str) -> DataFrame:
    return pathfinder.merged(star.analyses(spark, sf).select("result_id", "kedge_id", "score"))


@query("""with s as (select subject as supplier, count(distinct object) as n, sum(num_publications) as w from kg_edges where predicate = 'supplies' group by 1)
 select supplier as node_id, n as n_edges, round(w * 1.0 / (select sum(w) from s) + 1e-12, 9) as score from s where w * 1.0 / (select sum(w) from s) >= 0.001""")
def q40_set_input_answers(spark: SparkSession, sf: str) -> DataFrame:
    return pathfinder.set_answers(star.supplies(spark, sf), 0.001).withColumn("score", F.round(F.col("score") + 1e-12, 9))


@query("""select least(subject, object) as u, greatest(subject, object) as v, count(*) as parallel, sum(coalesce(affinity, 1.0)) as w from kg_edges group by 1, 2 having sum(coalesce(affinity, 1.0)) > 0""")
def q110_graph_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected and collapsed, with a default weight."""
    return graphs.shaped(star.kg_edges(spark, sf), "affinity", default=1.0, directed=False).where("w > 0")


@query("""with top as (select node, count(*) as n from (select subject as node from kg_edges union all select object from kg_edges) group by 1 order by 2 desc, 1 limit 15)
 select edge_id from kg_edges where num_publications > 1 and (subject in (select node from top) or object in (select node from top))""")
def q112_filter_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Two graph filters as one chain: by weight, then the edges that touch the 15 nodes of highest degree."""
    e = star.kg_edges(spark, sf)
    top = e.select(F.explode(F.array("subject", "object")).alias("node_id")).groupBy("node_id").count().orderBy(F.desc("count"), "node_id").limit(15)
    return e.where("num_publications > 1").transform(graphs.touching, top).select("edge_id")


@query("""select edge_id, l_partkey is not null as found from kg_edges e left join (select distinct l_partkey from lineitem where l_quantity > 49) f on e.object = 'PART:' || cast(l_partkey as varchar)""")
def q93_feature_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an edge's object has a feature; a miss counts as none."""
    have = star.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("PART:"), F.col("l_partkey").cast("string")).alias("object")).distinct().withColumn("found", F.lit(True))
    return star.kg_edges(spark, sf).join(have, "object", "left").select("edge_id", F.coalesce("found", F.lit(False)).alias("found"))


@query("""select row_number() over (order by score desc, result_id, pos) as k, result_id, pos from analyses qualify k <= 100""")
def q51_top_analyses(spark: SparkSession, sf: str) -> DataFrame:
    first = star.analyses(spark, sf).orderBy(F.desc("score"), "result_id", "pos").limit(100)  # a top-k report
    return first.select(F.row_number().over(W.orderBy(F.desc("score"), "result_id", "pos")).alias("k"), "result_id", "pos")


@query("""select count(*) as pairs, cast(round(sqrt(sum(w * w)), 3) as double) as norm from (select subject, object, sum(affinity) as w from kg_edges group by 1, 2)""")
def q97_adjacency_norm(spark: SparkSession, sf: str) -> DataFrame:
    """The Frobenius norm of the adjacency matrix, parallel edges added."""
    cells = star.kg_edges(spark, sf).groupBy("subject", "object").agg(F.sum("affinity").alias("w"))
    return cells.agg(F.count("*").alias("pairs"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 3).alias("norm"))


# Streams, drained


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream; the path is a pattern, since a stream takes no single file by its name."""
    return spark.readStream.schema(star.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("""select time_bucket(interval '1 hour', ts) as bucket, event_type as stream, count(*) as count, round(avg(value * 10), 6) as mean, min(value * 10) as min, max(value * 10) as max from events group by 1, 2""")
def q72_stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _stream(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("ts").alias("finished_at"), (F.col("value") * 10).alias("duration_ms"))
    found = streams.drained(streams.latency_windows(tasks, 3600), "latency")
    return found.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "stream", "count", F.round("mean", 6).alias("mean"), "min", "max")


@query("""select l_orderkey as response_id, cast(l_partkey as varchar) as answer, array_to_string(list_sort(list_distinct(list('sup|' || l_suppkey || '|' || l_partkey))), ',') as edges,
 max(cast(l_discount as double)) as score from lineitem group by 1, 2""")
def q73_stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_partkey").cast("string").alias("answer"), F.concat_ws("|", F.lit("sup"), "l_suppkey", "l_partkey").alias("kedge_id"), F.col("l_discount").cast("double").alias("score"))
    found = streams.drained(streams.merged_answers(rows), "merged")
    return found.withColumn("edges", F.concat_ws(",", "edges"))
