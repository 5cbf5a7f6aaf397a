"""The star schema read as a knowledge graph, ranked results, tasks and query states.

``VIEWS`` has the same views as SQL text that Spark and DuckDB both take; Spark builds them with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of ``lineitem`` that a task joins or counts, so that its memory doesn't grow with the table; a small table still gives every core some.
TASK_ROWS, LEAST_ROWS = 200_000, 20_000
#: Rows that go to all tasks, counted first.
FEW = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions keep each at ``TASK_ROWS`` rows or fewer on average."""
    return max(1, -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def _id(prefix: str, col: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, name, kind, cat1, cat2``."""
    place = [F.lit(x) for x in ("place",)]
    part = table(spark, sf_dir, "part").select(_id("PART:", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_type").alias("cat1"), F.col("p_brand").alias("cat2"))
    supplier = table(spark, sf_dir, "supplier").select(_id("SUPP:", "s_suppkey"), "s_name", F.lit("supplier"), F.lit("supplier"), F.lit("org"))
    customer = table(spark, sf_dir, "customer").select(_id("CUST:", "c_custkey"), "c_name", F.lit("customer"), "c_mktsegment", F.lit("org"))
    nation = table(spark, sf_dir, "nation").select(_id("NATION:", "n_nationkey"), "n_name", F.lit("nation"), F.lit("nation"), *place)
    region = table(spark, sf_dir, "region").select(_id("REGION:", "r_regionkey"), "r_name", F.lit("region"), F.lit("region"), *place)
    return part.union(supplier).union(customer).union(nation).union(region)


def _pairs(lines: DataFrame, key: str, n: int) -> DataFrame:
    """``key, l_partkey, n, p, a``: what an edge is made of, for each two keys of a line."""
    # most pairs have one line, so counting before the shuffle would only fill the memory of the tasks that read
    return lines.repartition(n, key, "l_partkey").groupBy(key, "l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount") + 0.0, 6).alias("p"), F.round(F.avg("l_tax") * 10 + 0.0, 6).alias("a"))


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_id, subject, object, predicate, source, num_publications, p_value, affinity``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_discount", "l_tax")
    n = parts_for(spark, lines.count())  # from the files' footers
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")

    def counted(df: DataFrame, key: str, short: str, prefix: str, predicate: str) -> DataFrame:
        grouped = _pairs(df, key, n)
        edge = F.concat(F.lit(f"{short}|"), F.col(key).cast("string"), F.lit("|"), F.col("l_partkey").cast("string"))
        return grouped.select(edge.alias("edge_id"), _id(prefix, key).alias("subject"), _id("PART:", "l_partkey").alias("object"), F.lit(predicate).alias("predicate"), F.concat(F.lit("src"), (F.col(key) % 5).cast("string")).alias("source"), F.col("n").alias("num_publications"), F.col("p").alias("p_value"), F.col("a").alias("affinity"))

    def fixed(name: str, key: str, other: str, short: str, prefix: str, to: str, predicate: str) -> DataFrame:
        none = F.lit(None).cast("double")
        return table(spark, sf_dir, name).select(F.concat(F.lit(short), F.col(key).cast("string")), _id(prefix, key), _id(to, other), F.lit(predicate), F.lit("src0"), F.lit(1).cast("long"), none, none)

    supplies = counted(lines, "l_suppkey", "sup", "SUPP:", "supplies")
    buys = counted(lines.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "buy", "CUST:", "buys")
    rest = [fixed("supplier", "s_suppkey", "s_nationkey", "loc|s", "SUPP:", "NATION:", "located_in"), fixed("customer", "c_custkey", "c_nationkey", "loc|c", "CUST:", "NATION:", "located_in"), fixed("nation", "n_nationkey", "n_regionkey", "prt|", "NATION:", "REGION:", "part_of")]
    out = supplies.union(buys)
    for df in rest:
        out = out.union(df)
    return out


def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_id, subject_name, object_name`` of the edges of ``kg_edges`` whose ends are both nodes, a row for each two nodes of their ids.

    Names are joined by the tables' keys before ids are made: customers' to orders, which are fewer than lines, and parts' where lines are
    made distinct, so that a line is shuffled once or twice and no id ever.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    n = parts_for(spark, lines.count())
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    m = parts_for(spark, orders.count())

    def names(name: str, key: str, col: str, parts: int) -> DataFrame:
        return table(spark, sf_dir, name).select(key, F.struct(F.col(col).alias("name")).alias("of")).repartition(parts, key).groupBy(key).agg(F.collect_list("of").alias("names"))

    def edge(id_: F.Column, subject: F.Column, object_: F.Column) -> list[F.Column]:
        return [id_.alias("edge_id"), subject.alias("subject_name"), object_.alias("object_name")]

    def pair(short: str, key: str) -> F.Column:
        return F.concat(F.lit(f"{short}|"), F.col(key).cast("string"), F.lit("|"), F.col("l_partkey").cast("string"))

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(n, "p_partkey")
    suppliers, customers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name"), names("customer", "c_custkey", "c_name", m)
    few = suppliers.count() <= FEW
    suppliers = F.broadcast(suppliers) if few else suppliers.repartition(n, "key")
    by_supplier = lambda df, key: (df if few else df.repartition(n, key)).join(suppliers, F.col(key) == F.col("key"))
    supplied = lines.select("l_suppkey", "l_partkey").repartition(n, "l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = by_supplier(supplied, "l_suppkey").select(*edge(pair("sup", "l_suppkey"), F.col("s_name"), F.col("p_name")))
    ordered = orders.repartition(m, "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "names").repartition(n, "o_orderkey")
    bought = lines.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.select("o_custkey", "l_partkey", "names").repartition(n, "l_partkey").dropDuplicates(["o_custkey", "l_partkey"]).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = out.union(bought.withColumn("of", F.explode("names")).select(*edge(pair("buy", "o_custkey"), F.col("of.name"), F.col("p_name"))))
    # 25 nations and 5 regions
    nation, region = (F.broadcast(table(spark, sf_dir, name)) for name in ("nation", "region"))
    nations = nation.select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("place"))
    placed = by_supplier(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(nations, F.col("s_nationkey") == F.col("at"))
    out = out.union(placed.select(*edge(_id("loc|s", "s_suppkey"), F.col("s_name"), F.col("place"))))
    placed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey").repartition(m, "key").join(customers, F.col("key") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("at"))
    out = out.union(placed.withColumn("of", F.explode("names")).select(*edge(_id("loc|c", "c_custkey"), F.col("of.name"), F.col("place"))))
    placed = nation.select("n_nationkey", "n_regionkey").join(nations, F.col("n_nationkey") == F.col("at")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.union(placed.select(*edge(_id("prt|", "n_nationkey"), F.col("place"), F.col("r_name"))))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplies edges alone; the filter on the predicate prunes the other branches."""
    return kg_edges(spark, sf_dir).where("predicate = 'supplies'")


def supplied_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_suppkey, l_partkey, n, p, a``: the supplies edges by the tables' keys, with their publications, p-value and affinity."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_tax")
    return _pairs(lines, "l_suppkey", parts_for(spark, lines.count()))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``result_id, pos, l_partkey, l_suppkey, l_extendedprice, l_discount``: the analyses by the tables' keys, those of a result in one partition."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount")
    n = parts_for(spark, lines.count())
    lines, orders = lines.repartition(n, "l_orderkey"), table(spark, sf_dir, "orders").select("o_orderkey").repartition(n, "o_orderkey")
    order = W.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderkey").alias("result_id"), F.row_number().over(order).alias("pos"), "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``result_id, pos, sn, on_, kedge_id, score``: a result an order, an analysis a line."""
    edge = F.concat(F.lit("sup|"), F.col("l_suppkey").cast("string"), F.lit("|"), F.col("l_partkey").cast("string"))
    return result_lines(spark, sf_dir).select("result_id", "pos", _id("PART:", "l_partkey").alias("sn"), _id("SUPP:", "l_suppkey").alias("on_"), edge.alias("kedge_id"), (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("score"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task_id, stream, consumer, finished_at, duration_ms``."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("consumer"), F.col("ts").alias("finished_at"), (F.col("value") * 10).alias("duration_ms"))


def query_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, start_time, state, domain``."""
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "ABANDONED").otherwise("QUEUED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.col("o_orderdate").alias("start_time"), state.alias("state"), F.col("o_orderpriority").alias("domain"))


VIEWS = {
    "kg_nodes": """select 'PART:'||cast(p_partkey as string) as node_id, p_name as name, 'part' as kind, p_type as cat1, p_brand as cat2 from part
 union all select 'SUPP:'||cast(s_suppkey as string), s_name, 'supplier', 'supplier', 'org' from supplier
 union all select 'CUST:'||cast(c_custkey as string), c_name, 'customer', c_mktsegment, 'org' from customer
 union all select 'NATION:'||cast(n_nationkey as string), n_name, 'nation', 'nation', 'place' from nation
 union all select 'REGION:'||cast(r_regionkey as string), r_name, 'region', 'region', 'place' from region""",
    "kg_edges": """select 'sup|'||cast(l_suppkey as string)||'|'||cast(l_partkey as string) as edge_id, 'SUPP:'||cast(l_suppkey as string) as subject,
 'PART:'||cast(l_partkey as string) as object, 'supplies' as predicate, 'src'||cast(l_suppkey % 5 as string) as source,
 cast(count(*) as bigint) as num_publications, round(avg(l_discount)+0.0,6) as p_value, round(avg(l_tax)*10+0.0,6) as affinity
 from lineitem group by l_suppkey, l_partkey
 union all select 'buy|'||cast(o_custkey as string)||'|'||cast(l_partkey as string), 'CUST:'||cast(o_custkey as string), 'PART:'||cast(l_partkey as string),
 'buys', 'src'||cast(o_custkey % 5 as string), cast(count(*) as bigint), round(avg(l_discount)+0.0,6), round(avg(l_tax)*10+0.0,6)
 from lineitem join orders on l_orderkey=o_orderkey group by o_custkey, l_partkey
 union all select 'loc|s'||cast(s_suppkey as string), 'SUPP:'||cast(s_suppkey as string), 'NATION:'||cast(s_nationkey as string), 'located_in', 'src0', cast(1 as bigint), cast(null as double), cast(null as double) from supplier
 union all select 'loc|c'||cast(c_custkey as string), 'CUST:'||cast(c_custkey as string), 'NATION:'||cast(c_nationkey as string), 'located_in', 'src0', cast(1 as bigint), cast(null as double), cast(null as double) from customer
 union all select 'prt|'||cast(n_nationkey as string), 'NATION:'||cast(n_nationkey as string), 'REGION:'||cast(n_regionkey as string), 'part_of', 'src0', cast(1 as bigint), cast(null as double), cast(null as double) from nation""",
    "analyses": """select o_orderkey as result_id,
 row_number() over (partition by o_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) as pos,
 'PART:'||cast(l_partkey as string) as sn, 'SUPP:'||cast(l_suppkey as string) as on_,
 'sup|'||cast(l_suppkey as string)||'|'||cast(l_partkey as string) as kedge_id, floor(l_extendedprice*(1-l_discount)*100+0.5)/100 as score
 from lineitem join orders on l_orderkey=o_orderkey""",
    "tasks": "select event_id as task_id, event_type as stream, cast(user_id as string) as consumer, ts as finished_at, value*10 as duration_ms from events",
    "query_state": """select cast(o_orderkey as string) as qid, o_orderdate as start_time,
 case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'ABANDONED' else 'QUEUED' end as state, o_orderpriority as domain from orders""",
}


def with_views(body: str) -> str:
    """``body`` (a SELECT, or further WITH items and one) below the views that it names."""
    import re

    used = [f"{name} as ({sql})" for name, sql in VIEWS.items() if re.search(rf"\b{name}\b", body)]
    rest = body.strip()
    more = rest[4:].lstrip() if rest.lower().startswith("with ") else None
    return f"with {', '.join(used)}{',' if more else ''} {more or rest}" if used else rest
