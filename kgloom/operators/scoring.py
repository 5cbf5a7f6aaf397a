"""Scores of edges, analyses and results, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.operators.checkpoints import kept

# Fixed values: (lower, upper, mid, rate) of the blended profile's sigmoids by (source, property); "unknown" stands for all other sources.
SIGMOIDS = {
    ("infores:omnicorp", "literature_co-occurrence"): (-1, 1, 0, 0.00033),
    ("infores:text-mining-provider-targeted", "publications"): (-1, 1, 0, 4e-4),
    ("infores:text-mining-provider-targeted", "confidence_score"): (-1, 1, 0, 3),
    ("infores:genetics-data-provider", "p_value"): (0, 1, 0.05, -150),
    ("infores:icees-kg", "p_value"): (0, 1, 0.05, -150),
    ("infores:gwas-catalog", "p_value"): (0, 1, 0.05, -150),
    ("unknown", "publications"): (-1, 1, 0, 0.574213221),
    ("unknown", "literature_co-occurrence"): (-1, 1, 0, 0.001373265360835),
    ("unknown", "affinity"): (-1, 1, 0, 0.4),
}
# The blended profile's weights by (source, property), and base weights by source.
SOURCE_WEIGHTS = {("infores:omnicorp", "literature_co-occurrence"): 1, ("infores:text-mining-provider-targeted", "publications"): 0.5, ("infores:text-mining-provider-targeted", "confidence_score"): 1, ("infores:genetics-data-provider", "p_value"): 1, ("infores:icees-kg", "p_value"): 1, ("infores:gwas-catalog", "p_value"): 1, ("unknown", "publications"): 1, ("unknown", "literature_co-occurrence"): 1, ("unknown", "affinity"): 1}
BASE_WEIGHTS = {"infores:omnicorp": 0, "infores:drugcentral": 5e-2, "infores:hetionet": 3e-2, "infores:text-mining-provider-targeted": 5e-3, "infores:icees-kg": 3e-2, "infores:gwas-catalog": 3e-2}
QUERY_EDGE = -1 / math.log(1e-3)
BASE_WEIGHT = 0.01
ARTICLES = 27_840_000
#: A value that more than this part of the rows has is looked up by broadcast.
HOT_VALUES = 1000
# How far each attribute is trusted.
TRUST = {"probability": 0.8, "normalized_google_distance": 0.8, "jaccard_index": 0.5, "probability_treats": 0.8, "paired_concept_frequency": 0.5, "observed_expected_ratio": 0.8, "chi_square": 0.8, "chi_square_pvalue": 0.8, "MAGMA-pvalue": 1, "Genetics-quantile": 1, "pValue": 1, "fisher_exact_test_p-value": 0.8, "Richards-effector-genes": 0.5, "feature_coefficient": 1, "CMAP similarity score": 1}


def sigmoid(value: Column, source: str, prop: str) -> Column:
    lower, upper, mid, rate = SIGMOIDS[source, prop]
    return lower + (upper - lower) / (1 + F.exp(-rate * (value - mid)))


def profiled(edges: DataFrame, prop: str) -> DataFrame:
    """Add ``base, weight``: the base weight of an edge's ``source``, and its value of ``prop`` by the blended profile; 0 where the profile
    gives the source no weight for it or the value is null."""
    base = F.lit(BASE_WEIGHT)
    for source, w in BASE_WEIGHTS.items():
        base = F.when(F.col("source") == source, F.lit(float(w))).otherwise(base)
    weight, known = F.lit(0.0), [s for s in {s for s, _ in SIGMOIDS} if s != "unknown"]
    if ("unknown", prop) in SIGMOIDS:
        weight = F.when(~F.col("source").isin(known), SOURCE_WEIGHTS["unknown", prop] * sigmoid(F.col(prop), "unknown", prop)).otherwise(weight)
    for source in sorted(known):
        if (source, prop) in SIGMOIDS:
            weight = F.when(F.col("source") == source, SOURCE_WEIGHTS[source, prop] * sigmoid(F.col(prop), source, prop)).otherwise(weight)
    return edges.withColumns({"base": base, "weight": F.coalesce(weight, F.lit(0.0))})


def admittance(weight: Column) -> Column:
    """-1/ln(w); a weight of 1 or more just below it, one of 0 or less nothing."""
    return F.when(weight > 0, -1 / F.log(F.least(weight, F.lit(0.9999999)))).otherwise(0.0)


def two_node_resistance(edges: DataFrame, *keys: str) -> DataFrame:
    """The resistance score of each pair of nodes: base, publication and query-edge admittances in parallel."""
    w = admittance(F.lit(BASE_WEIGHT)) + admittance(sigmoid(F.col("num_publications"), "unknown", "publications"))
    return edges.groupBy(*keys).agg(F.exp(-1 / (F.sum(w) + QUERY_EDGE)).alias("score"))


def noisy_or(scores: Column, base: Column) -> Column:
    """1 - (1 - base) * product(1 - s) of an array."""
    return 1 - F.aggregate(scores, 1 - base, lambda acc, s: acc * (1 - s))


def quantile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the share of rows at or below, as ``cume_dist``."""
    return quantile_ranks(df, {value: name})


def quantile_ranks(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """``df`` with a column for each of the values that ``named`` maps: the share of rows at or below, as ``cume_dist``.

    Values compare as doubles. Equal values of all columns are counted first and the counts dealt by range of column and value, in one pass; a range's values add
    the counts of the ranges before. Values that many rows have are few and join as a broadcast; their rows are spread over the
    tasks of the join with the other values, where they meet nothing.
    """
    df = kept(df)  # it is read twice
    columns = list(named)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("_n"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns))))
    counted = df.select(cells.alias("_c")).groupBy("_c._n", "_c._v").agg(F.count("*").alias("_k"))
    ranged = kept(counted.repartitionByRange("_n", "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_n", "_part").agg(F.sum("_k").alias("_own"))  # a row a range and column
    ahead = sums.select("_n", "_part", (F.sum("_own").over(W.partitionBy("_n").orderBy("_part")) - F.col("_own")).alias("_ahead"))
    total = ranged.where("_n = 0").agg(F.sum("_k")).first()[0] or 1
    upto = F.col("_ahead") + F.sum("_k").over(W.partitionBy("_n", "_part").orderBy("_v"))
    ranks = ranged.join(F.broadcast(ahead), ["_n", "_part"]).select("_n", "_v", (upto / total).alias("_rank"), (F.col("_k") * HOT_VALUES > total).alias("_hot"))
    out = df
    for i, c in enumerate(columns):
        own = ranks.where(F.col("_n") == i)
        hot = own.where("_hot").select(F.col("_v").alias("_w"), F.col("_rank").alias("_often"))  # fewer than HOT_VALUES
        rest = own.where("not _hot").select(F.col("_v").alias("_w"), F.col("_rank").alias("_seldom"), F.lit(0).alias("_t"))
        out = out.join(F.broadcast(hot), F.col(c).cast("double").eqNullSafe(F.col("_w")), "left").drop("_w")
        spread = F.when(F.col("_often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(100_000)).cast("int"))
        out = out.withColumn("_s", spread).join(rest, F.col(c).cast("double").eqNullSafe(F.col("_w")) & (F.col("_s") == F.col("_t")), "left")
        out = out.withColumn(named[c], F.coalesce("_often", "_seldom")).drop("_w", "_t", "_s", "_often", "_seldom")
    return out


def ties_broken(df: DataFrame, key: str, rank_score: str, *order: Column) -> DataFrame:
    """``key, score``: scores of the first 1000 rows in thousandths, strictly falling by one at least, not below 0: an integer running
    minimum; 0 for all others."""
    w = W.orderBy(*order)
    i = F.row_number().over(w)
    own = F.round(F.col(rank_score) * 1000).cast("long") + i
    first = kept(df.orderBy(*order).limit(1000))  # all that the window sees
    top = first.select(key, (F.greatest(F.lit(0), F.min(own).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - i) / 1000.0).alias("score"))
    return top.union(df.join(F.broadcast(first.select(key)), key, "left_anti").select(key, F.lit(0.0).alias("score")))


def logistic(x: Column, steep: float, mid: float) -> Column:
    return 1 / (1 + F.exp(-steep * (x - mid)))


# Steepness and midpoint of the logistic normalizers, by attribute and by what the curve runs over.
CURVES = {"publications": ("log", 3.16993, 1.60943), "probability_treats": ("value", 15, 0.6), "normalized_google_distance": ("value", -9, 0.6), "probability": ("value", 20, 0.8), "paired_concept_frequency": ("value", 2000, 0.002), "observed_expected_ratio": ("value", 2, 2), "chi_square": ("-log", 0.03, 200), "chi_square_pvalue": ("-log", 0.03, 200), "MAGMA-pvalue": ("-log", 0.849, 4.97), "pValue": ("-log", 0.849, 4.97), "fisher_exact_test_p-value": ("-log", 3, 2.7), "feature_coefficient": ("log abs", 2.75, 0.15)}
#: p-values at or below these count as certain.
_CERTAIN = {"fisher_exact_test_p-value": 2.220446049250313e-16}


def normalized(name: str, x: Column, most: Column | None = None) -> Column:
    """An attribute's value on the scale 0 to 1; ``most`` is the largest value seen, for those that are scaled by it."""
    if name in ("Genetics-quantile", "Richards-effector-genes"):
        return x
    if name == "CMAP similarity score":
        return F.abs(x / 100)
    if name == "jaccard_index":
        return x if most is None else F.when(most.isNull() | (most == 0), x).otherwise(x / most)
    over, steep, mid = CURVES[name]
    if over == "value":
        return logistic(x, steep, mid)
    if over == "-log":
        return F.when(x <= _CERTAIN.get(name, 0.0), 1.0).otherwise(logistic(-F.log(x), steep, mid))
    if over == "log abs":
        return F.when(x == 0, 0.0).otherwise(logistic(F.log(F.abs(x)), steep, mid))
    return F.when(x == 0, 0.0001).otherwise(logistic(F.log(x), steep, mid))


def dispatched(name: Column, text: Column, most: Column | None = None) -> Column:
    """The normalized value of an attribute known by a column: -1 for an unknown name, 0 for "no value!" and what is no number."""
    value = text.try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    out = F.lit(-1.0)
    for known in TRUST:
        out = F.when(name == known, F.coalesce(normalized(known, value, most), F.lit(0.0))).otherwise(out)
    return out


def cooccurrence(shared: Column, a: Column, b: Column, total: int = ARTICLES) -> Column:
    """What two terms share beyond chance, in articles."""
    t = F.lit(float(total))
    return F.greatest(shared / t - a / t * (b / t), F.lit(0.0)) * t


def publications(value: Column) -> Column:
    """Identifiers in a string: by pipe, or else by comma."""
    return F.when(value.contains("|"), F.split(value, "\\|")).otherwise(F.split(value, ","))


def is_p_value(name: Column) -> Column:
    return name.rlike("p_value|p-value|pValue|fisher_exact_p|gwas_pvalue")
