"""Attributes of any type as one map an entity, edge weights from them, and a message's edges as a graph in four forms.

Attributes are ``array<struct<original_attribute_name string, attribute_type_id string, value variant>>``. A map's values are JSON texts, so a
number, a text and a list stay apart.

Nulls: null or empty attributes give an empty map; a null value is JSON's ``null``; an edge with a null end is left out; a null edge id
becomes its place. Repeated node rows are one node. Edges need places (``pos``) without ties where the order matters (forms ``full``, ``first``
and ``mean``). Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ATTRIBUTES = "array<struct<original_attribute_name:string,attribute_type_id:string,value:variant>>"
_KEYED = "array<struct<key:string,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is evaluated once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flattened(attributes: Column) -> Column:
    """``map<string, string>`` of a list of attributes.

    A key is the original name, else the type's id, else ``attr_<n>`` with n the keys before it; an empty name counts as none. A key's
    second and later values join its first in a list; a first value that is a list already is the list that they join.
    """
    def named(a: Column) -> Column:
        return F.coalesce(F.nullif(a["original_attribute_name"], F.lit("")), F.nullif(a["attribute_type_id"], F.lit("")))

    def add(done: Column, a: Column) -> Column:
        so_far = F.size(F.array_distinct(F.transform(done, lambda x: x["key"])))
        key = F.coalesce(named(a), F.concat(F.lit("attr_"), so_far.cast("string")))
        return F.concat(done, F.array(F.struct(key.alias("key"), F.coalesce(F.to_json(a["value"]), F.lit("null")).alias("value"))))

    def value(key: Column, own: Column) -> Column:
        head = F.get(own, F.lit(0))
        rest = F.array_join(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), ",")
        opened = F.when(head.startswith("["), F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(F.concat(F.lit("["), head))
        comma = F.when(opened == "[", "").otherwise(",")
        return F.struct(key.alias("key"), F.when(F.size(own) == 1, head).otherwise(F.concat(opened, comma, rest, F.lit("]"))).alias("value"))

    def entries(keyed: Column) -> Column:
        of = lambda key: F.transform(F.filter(keyed, lambda x: x["key"] == key), lambda x: x["value"])
        keys = F.array_distinct(F.transform(keyed, lambda x: x["key"]))
        return F.when(F.size(keys) == F.size(keyed), keyed).otherwise(F.transform(keys, lambda key: _once(of(key), lambda own: value(key, own))))

    def keyed(own: Column) -> Column:
        # with one attribute without a name, the keys before it are names
        def placed(a: Column, i: Column) -> Column:
            key = F.coalesce(named(a), F.concat(F.lit("attr_"), F.size(F.array_distinct(F.transform(F.slice(own, F.lit(1), i), named))).cast("string")))
            return F.struct(key.alias("key"), F.coalesce(F.to_json(a["value"]), F.lit("null")).alias("value"))

        return F.when(F.size(F.filter(own, lambda a: named(a).isNull())) <= 1, F.transform(own, placed)).otherwise(F.aggregate(own, F.array().cast(_KEYED), add))

    own = F.coalesce(attributes, F.array().cast(ATTRIBUTES))
    return F.map_from_entries(_once(_once(own, keyed), entries))


def weight(flat: Column, name: str, default: float = 1.0, transform: Callable[[Column], Column] | None = None) -> Column:
    """An edge's weight: the number that ``name`` has in ``flat``, of a list its first; ``default`` where there is none or it is no number.
    Where ``transform`` gives null, the number counts as it is."""
    found = F.try_parse_json(F.element_at(flat, F.lit(name)))
    path = lambda p: F.try_variant_get(found, p, "double")
    number = F.when(F.element_at(flat, F.lit(name)).startswith("["), path("$[0]")).otherwise(path("$"))
    changed = F.coalesce(transform(number), number) if transform else number
    return F.coalesce(changed, F.lit(float(default)))


def nodes(listed: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, flat, listed``: the listed nodes (``node_id, attributes``), and ends of edges that are not listed, without attributes."""
    own = listed.where("node_id is not null").select("node_id", flattened(F.col("attributes")).alias("flat"), F.lit(True).alias("listed"))
    own = own.dropDuplicates(["node_id"])
    whole = edges.where("subject is not null and object is not null")
    ends = whole.select(F.col("subject").alias("node_id")).union(whole.select("object")).distinct()
    bare = ends.join(own.select("node_id"), "node_id", "left_anti")
    return own.union(bare.select("node_id", F.create_map().cast("map<string,string>"), F.lit(False)))


def placed(edges: DataFrame, directed: bool = True, weight_name: str | None = None, default: float = 1.0, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """``u, v, id, pos, predicate, flat, weight``: a row an edge (``edge_id, pos, subject, object, predicate, attributes``), as a multigraph has
    them. Undirected, the lesser end is ``u``. Without ``weight_name`` the weight is null."""
    s, o = F.col("subject"), F.col("object")
    u, v = (s, o) if directed else (F.least(s, o), F.greatest(s, o))
    flat = edges.where("subject is not null and object is not null").select(u.alias("u"), v.alias("v"), F.coalesce("edge_id", F.col("pos").cast("string")).alias("id"), "pos", "predicate", flattened(F.col("attributes")).alias("flat"))
    own = weight(F.col("flat"), weight_name, default, transform) if weight_name else F.lit(None).cast("double")
    return flat.withColumn("weight", own)


def undirected(rows: DataFrame) -> DataFrame:
    """``placed`` rows of a directed graph as those of the undirected one."""
    return rows.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def collapsed_full(rows: DataFrame) -> DataFrame:
    """``u, v, id, predicate, flat, weight``: one edge for each pair of ends. The last edge's data stay; where it names no predicate, the last
    one that was named does. Maxima are merged before the shuffle, so a pair with many edges is no hot key."""
    last = F.max_by(F.struct("id", "flat", "weight"), "pos").alias("last")
    named = F.max_by("predicate", F.when(F.col("predicate").isNotNull(), F.col("pos"))).alias("predicate")
    return rows.groupBy("u", "v").agg(last, named).select("u", "v", "last.id", "predicate", "last.flat", "last.weight")


def collapsed_weights(rows: DataFrame, how: str = "sum") -> DataFrame:
    """``u, v, weight``: one edge for each pair of ends, its weight the ``sum``, ``max``, ``min`` or ``first`` of the edges', or their ``mean``: the
    weight so far and the next one's halved, in order of place. Weights that are off (null) stay null."""
    return collapsed_forms(rows, {"weight": (how, F.col("weight"))})


def collapsed_forms(rows: DataFrame, forms: dict[str, tuple[str, Column]]) -> DataFrame:
    """``u, v`` and a column a form: ``collapsed_weights`` of several ways (name: way, weight) after one shuffle."""
    weights = {f"_{i}": weight for i, (_, weight) in enumerate(forms.values())}
    own = rows.select("u", "v", "pos", *(weight.alias(name) for name, weight in weights.items()))
    if any(how == "mean" for how, _ in forms.values()):
        # the edge r places before a pair's last counts 2^-(r+1), the first as much as the second
        r = F.row_number().over(W.partitionBy("u", "v").orderBy(F.col("pos").desc()))
        own = own.withColumns({"r": r, "n": F.count("*").over(W.partitionBy("u", "v"))})
    share = F.pow(F.lit(0.5), F.col("r") - F.when(F.col("r") == F.col("n"), 1).otherwise(0))
    by = {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda w: F.min_by(w, "pos"), "mean": lambda w: F.sum(F.col(w) * share)}
    for how, _ in forms.values():
        if how not in by:
            raise ValueError(f"no such way to combine weights: {how}")
    return own.groupBy("u", "v").agg(*(by[how](w).alias(name) for w, (name, (how, _)) in zip(weights, forms.items(), strict=True)))
