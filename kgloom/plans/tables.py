"""Plans for many queries at once: rows ``query_id, subject_ids, object_ids, predicate, aspect, direction, inferred`` of one-edge queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def examined(queries: DataFrame) -> DataFrame:
    """``query_id, infer, question, answer, pinned``: an inferred query's pinned and open end, and the pinned id. Raises where both ends or
    none are pinned."""
    s, o = F.size("subject_ids") > 0, F.size("object_ids") > 0
    bad = F.col("inferred") & (s == o)
    question = F.when(bad, F.raise_error(F.lit("an inferred edge needs one pinned node"))).when(F.col("inferred"), F.when(s, "subject").otherwise("object"))
    answer = F.when(F.col("inferred"), F.when(s, "object").otherwise("subject"))
    pinned = F.when(F.col("inferred"), F.get(F.when(s, F.col("subject_ids")).otherwise(F.col("object_ids")), F.lit(0)))
    return queries.select("query_id", F.col("inferred").alias("infer"), question.alias("question"), answer.alias("answer"), pinned.alias("pinned"))


def rule_key() -> Column:
    """Predicate, aspect and direction as JSON with sorted keys; what is null is left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{key}": "'), F.col(c), F.lit('"'))) for c, key in (("aspect", "object_aspect_qualifier"), ("direction", "object_direction_qualifier"), ("predicate", "predicate"))]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def canonical() -> Column:
    """A text that equivalent queries share: ids in order, constraints with sorted keys."""
    ids = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return F.concat_ws("|", ids("subject_ids"), ids("object_ids"), rule_key())


def expanded(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """``query_id, n, text``: the direct query, then one for each rule (``predicate, aspect, direction, n, template``) of its key, with the ids
    of its ends filled in. Rules are a small table, joined by their key."""
    source, target = (F.coalesce(F.get(c, F.lit(0)), F.lit("")) for c in ("subject_ids", "object_ids"))
    direct = queries.select("query_id", F.lit(0).alias("n"), F.concat(source, F.lit(" direct "), target).alias("text"))
    r = rules.select(rule_key().alias("key"), "n", "template")
    filled = queries.withColumn("key", rule_key()).join(r, "key").select("query_id", "n", F.replace(F.replace("template", F.lit("$source"), source), F.lit("$target"), target).alias("text"))
    return direct.union(filled)


def matched_groups(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """``query_id, name`` of the template groups (``name, predicates, qualifiers``) that have the query's predicate and equal qualifiers.
    Groups are exploded to keys, so the match is an equi-join."""
    text = lambda c: F.concat_ws(",", F.array_sort(c))
    keys = groups.select("name", F.explode("predicates").alias("predicate"), text(F.col("qualifiers")).alias("qualifiers"))
    own = queries.select("query_id", "predicate", F.coalesce("direction", F.lit("")).alias("qualifiers"))
    return own.join(keys, ["predicate", "qualifiers"]).select("query_id", "name").distinct()


def routed(queries: DataFrame) -> DataFrame:
    """``query_id, step, op``: the steps of each query's workflow in order."""
    return queries.select("query_id", F.posexplode("workflow").alias("step", "op"))
