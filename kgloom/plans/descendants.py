"""Hierarchies of categories and predicates, and lookups of many queries that hold for everything below what a query names.

``closure`` turns a table of ``child, parent`` into ``above, below`` by doubling: a round joins the pairs found so far with themselves, so a
hierarchy of depth d takes about log2(d) rounds. Each name is below itself. Several parents and cycles are allowed.

``looked_up`` binds one-edge queries to edges. An edge fits if its predicate is at or below one of the query's, each end has a
category at or below one of the query's for that end (no list: any) and the id that the query pins (none: any), and its qualifiers
contain each of the query's, its value at or below the query's value. Constraints of different queries are keys of joins, not loops.

A query without predicates has no answer; one for any predicate names the hierarchy's top.

Nulls: null names, parents and ids are no name; a null list or map is an empty one; an edge with a null end is no answer. Repeated rows
of queries, edges, categories or parents count once. Empty queries or edges give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import drop, step

_NONE, _MAP = "array<string>", "map<string,string>"
#: Rows of a table of shapes or pinned queries that go to all tasks, counted before.
SMALL = 50_000


def bare(name: Column) -> Column:
    """A name without its prefix."""
    return F.regexp_replace(name, "^biolink:", "")


def closure(parents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``above, below`` of every pair in ``parents`` (``child, parent``), each name with itself; ``names`` (``name``) may add ones without
    parents. Paths of length up to 2^k are known after k rounds, and the loop ends with the round that finds no pair."""
    pairs = parents.select(bare("parent").alias("above"), bare("child").alias("below")).where("above is not null and below is not null")
    alone = pairs.select("above").union(pairs.select("below"))
    if names is not None:
        alone = alone.union(names.select(bare("name")).where("name is not null"))
    found = step(pairs.union(alone.select("above", F.col("above").alias("below"))).distinct(), "closure")
    size = found.count()
    while True:
        # each name is below itself, so this holds the shorter pairs too
        longer = step(found.alias("a").join(found.alias("b"), F.col("a.below") == F.col("b.above")).select("a.above", "b.below").distinct(), "closure")
        grown = longer.count()
        drop(found)
        if grown == size:
            return longer
        found, size = longer, grown


def spread(big: DataFrame, small: DataFrame, on: list[str], parts: int = 32) -> DataFrame:
    """``big`` joined with ``small``, ``big``'s rows of one key dealt to ``parts`` tasks and ``small``'s rows repeated for each: for a
    small side with few rows a key, whatever share of ``big`` one key has."""
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(*(c for c, t in big.dtypes if not t.startswith("map"))), F.lit(parts)).cast("int"))
    return dealt.join(small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*on, "_part"]).drop("_part")


def _list(col: str) -> Column:
    return F.array_distinct(F.transform(F.coalesce(col, F.array().cast(_NONE)), bare))


def _below(names: DataFrame, pairs: DataFrame, key: str, col: str) -> DataFrame:
    """``key, col``: the names of ``names`` (``key, above``) and all below them; a name that no hierarchy has stands for itself."""
    got = names.join(pairs, "above", "left").select(key, F.explode(F.array_distinct(F.array(F.col("above"), F.coalesce("below", "above")))).alias(col))
    return got.distinct()


def looked_up(queries: DataFrame, edges: DataFrame, categories: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id, edge_id`` of every edge that fits a query.

    ``queries``: ``query_id, predicates, subject_categories, object_categories`` (arrays), ``qualifiers`` (map), ``subject_id, object_id``.
    ``edges``: ``edge_id, subject, object, predicate, qualifiers`` (map). ``categories``: ``node_id, category``. ``pairs``: ``closure``.

    What a query asks of qualifiers and of an end's categories is one of few shapes, and so is what an edge or a node has. Shapes are matched
    with each other first, so that an edge met by predicate and pinned id is taken or left at once and only answers are shuffled again.
    """
    q = queries.select("query_id", _list("predicates").alias("predicates"), _list("subject_categories").alias("sc"), _list("object_categories").alias("oc"), F.coalesce("qualifiers", F.create_map().cast(_MAP)).alias("asked"), "subject_id", "object_id")
    wanted = _below(q.select("query_id", F.explode("predicates").alias("above")), pairs, "query_id", "predicate").join(q, "query_id")
    wanted = step(wanted.select("query_id", "predicate", "subject_id", "object_id", _text("sc").alias("sc"), _text("oc").alias("oc"), _shape("asked").alias("asked")), "wanted")
    kinds = categories.where("node_id is not null and category is not null").groupBy("node_id").agg(F.sort_array(F.collect_set(bare("category"))).alias("all"))
    kinds = step(kinds.select("node_id", _text("all").alias("kind")), "kinds")  # a node's own few categories
    e = edges.select("edge_id", "subject", "object", bare("predicate").alias("predicate"), _shape(F.coalesce("qualifiers", F.create_map().cast(_MAP))).alias("has")).where("subject is not null and object is not null")
    e = step(_kind(e, kinds, "object", "object_kind"), "edges")

    one = lambda df, c: df.select(F.col(c).alias("shape")).distinct()
    lists = one(wanted, "sc").union(one(wanted, "oc")).distinct().select("shape", F.explode(F.from_json("shape", _NONE)).alias("above"))
    theirs = one(kinds, "kind").select(F.col("shape").alias("kind"), F.explode(F.from_json("shape", _NONE)).alias("category"))
    fit = step(_below(lists, pairs, "shape", "category").join(theirs, "category").select("shape", "kind").distinct(), "fit")
    asks = one(wanted, "asked").select("shape", F.from_json("shape", f"array<{_NONE}>").alias("each"))
    asks = asks.select("shape", F.size("each").alias("n"), F.explode("each").alias("x")).select("shape", "n", F.col("x")[0].alias("key"), bare(F.col("x")[1]).alias("above"))
    under = asks.join(pairs, "above", "left").select("shape", "n", "key", F.explode(F.array_distinct(F.array(F.col("above"), F.coalesce("below", "above")))).alias("value")).distinct()
    has = one(e, "has").select(F.col("shape").alias("has"), F.explode(F.from_json("shape", f"array<{_NONE}>")).alias("x")).select("has", F.col("x")[0].alias("key"), bare(F.col("x")[1]).alias("value"))
    full = under.join(has, ["key", "value"]).groupBy("shape", "has").agg(F.count_distinct("key").alias("found"), F.first("n").alias("n")).where("found = n")
    full = step(full.select("shape", "has"), "full")

    # a pinned end is looked at where the query is, the other where the edge is
    by_s, by_o, free = wanted.where("subject_id is not null"), wanted.where("subject_id is null and object_id is not null"), wanted.where("subject_id is null and object_id is null")
    by_s = _fitting(_kind(by_s, kinds, "subject_id", "kind"), fit, "sc", "kind").drop("kind")
    met = e.join(by_s.withColumnRenamed("subject_id", "subject"), ["predicate", "subject"]).where("object_id is null or object_id = object").select("query_id", "edge_id", "asked", "has", "oc", "object_kind")
    got = _fitting(_fitting(met, full, "asked", "has"), fit, "oc", "object_kind").select("query_id", "edge_id")
    few = by_o.count() <= SMALL
    by_o = by_o.drop("subject_id").withColumnRenamed("object_id", "object")
    rest = e.join(F.broadcast(by_o) if few else by_o, ["predicate", "object"])
    spare = e.join(F.broadcast(free), ["predicate"]) if free.count() <= SMALL else spread(e, free, ["predicate"])  # one predicate may have a third of all edges
    cols = ["query_id", "edge_id", "subject", "asked", "has", "sc", "oc", "object_kind"]
    rest = _fitting(_fitting(rest.select(cols).union(spare.select(cols)), full, "asked", "has"), fit, "oc", "object_kind")
    rest = _fitting(_kind(rest.select("query_id", "edge_id", "subject", "sc"), kinds, "subject", "kind"), fit, "sc", "kind")
    out = step(got.union(rest.select("query_id", "edge_id")).distinct(), "met")
    drop(wanted, kinds, e, fit, full)
    return out


def _text(col: str) -> Column:
    """A list of names as one text, the same for any order."""
    return F.to_json(F.array_sort(col))


def _shape(col: str | Column) -> Column:
    """A map as one text of its sorted keys and values."""
    return F.to_json(F.array_sort(F.transform(F.map_entries(col), lambda x: F.array(x["key"], x["value"]))))


def _kind(df: DataFrame, kinds: DataFrame, end: str, name: str) -> DataFrame:
    """``df`` with the kind of the node at ``end``, null for one without categories."""
    return df.join(kinds.select(F.col("node_id").alias(end), F.col("kind").alias(name)), end, "left")


def _fitting(df: DataFrame, fit: DataFrame, asked: str, has: str) -> DataFrame:
    """The rows that ask for nothing or whose shapes ``asked`` and ``has`` fit; ``fit`` (two columns) goes to all tasks if it is counted as small."""
    known = fit.toDF(asked, has).withColumn("_fits", F.lit(True))
    known = F.broadcast(known) if fit.count() <= SMALL else known
    return df.join(known, [asked, has], "left").where((F.col(asked) == "[]") | F.col("_fits")).drop("_fits")
