"""Attributes of any type, weights, and graphs in four forms."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kgloom.operators import payload

GIVEN = "array<struct<original_attribute_name:string,attribute_type_id:string,value:variant>>"


def _given(spark, rows, schema="edge_id string, pos long, subject string, object string, predicate string, text string, flat string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("attributes", F.from_json("text", GIVEN))


def _text(*attributes):
    return json.dumps([{k: v for k, v in zip(("original_attribute_name", "attribute_type_id", "value"), a, strict=True) if v is not ...} for a in attributes])


def test_keys_and_repeated_keys(spark):
    cases = {
        _text(("a", "t", 1), ("", "t", "x"), (..., ..., True), (None, None, None)): {"a": 1, "t": "x", "attr_2": True, "attr_3": None},
        _text(("a", ..., 1), ("a", ..., "2"), (..., "a", [3])): {"a": [1, "2", [3]]},
        _text(("a", ..., [1, 2]), ("a", ..., {"k": 1})): {"a": [1, 2, {"k": 1}]},
        _text(("a", ..., []), ("a", ..., 5)): {"a": [5]},
        _text(("a", ..., 1), ("a", ..., 1), (..., ..., 7)): {"a": [1, 1], "attr_1": 7},
        _text((..., ..., 7), ("attr_0", ..., 8)): {"attr_0": [7, 8]},
        _text(("a", ..., ...)): {"a": None},
        "[]": {},
        None: {},
    }
    rows = [(None, k, "s", "o", None, text, "clash") for k, text in enumerate(cases)]
    found = _given(spark, rows).select("pos", payload.flattened(F.col("attributes")).alias("found")).collect()
    assert {r.pos: {k: json.loads(v) for k, v in r.found.items()} for r in found} == dict(enumerate(cases.values()))


def test_weights_fall_back(spark):
    cases = [("0.5", 0.5), ('"0.25"', 0.25), ("[4, 1]", 4.0), ('"x"', 9.0), ("null", 9.0), ("[]", 9.0), ("true", 1.0), ("{}", 9.0), ('["3"]', 3.0), ("[[1]]", 9.0), (None, 9.0)]
    rows = [(k, None if t is None else {"w": t}) for k, (t, _) in enumerate(cases)] + [(98, {"other": "1"})]
    df = spark.createDataFrame(rows, "k int, flat map<string,string>")
    assert {r.k: r.w for r in df.select("k", payload.weight(F.col("flat"), "w", 9).alias("w")).collect()} == {k: w for k, (_, w) in enumerate(cases)} | {98: 9.0}
    logs = {r.k: r.w for r in df.select("k", payload.weight(F.col("flat"), "w", 9, lambda x: F.when(x < 1, F.log(x))).alias("w")).collect()}
    assert math.isclose(logs[0], math.log(0.5)) and logs[2] == 4.0 and logs[4] == 9.0


def test_four_forms(spark):
    w = lambda x: _text(("w", ..., x))
    rows = [("e1", 1, "A", "B", "p", w(1.0), ""), ("e2", 2, "B", "A", None, w(3.0), ""), (None, 3, "A", "B", None, w(8.0), ""), ("e4", 4, "A", None, "p", w(1), ""), ("e5", 5, "C", "C", "q", None, ""), ("e6", 6, "A", "B", None, w(2.0), "")]
    edges = _given(spark, rows)
    multi = payload.placed(edges, True, "w")
    assert sorted((r.u, r.v, r.id, r.weight) for r in multi.collect()) == [("A", "B", "3", 8.0), ("A", "B", "e1", 1.0), ("A", "B", "e6", 2.0), ("B", "A", "e2", 3.0), ("C", "C", "e5", 1.0)]
    assert {(r.u, r.v, r.id, r.predicate, r.weight, r.flat.get("w")) for r in payload.collapsed_full(multi).collect()} == {("A", "B", "e6", "p", 2.0, "2"), ("B", "A", "e2", None, 3.0, "3"), ("C", "C", "e5", "q", 1.0, None)}
    loose = payload.placed(edges, False, "w")
    want = {"sum": 14.0, "max": 8.0, "min": 1.0, "first": 1.0, "mean": ((1 + 3) / 2 + 8) / 4 + 1}
    for how, number in want.items():
        assert {(r.u, r.v): r.weight for r in payload.collapsed_weights(loose, how).collect()} == {("A", "B"): number, ("C", "C"): 1.0}, how
    assert {r.weight for r in payload.collapsed_weights(payload.placed(edges), "sum").collect()} == {None}
    with pytest.raises(ValueError):
        payload.collapsed_weights(loose, "median")
    listed = spark.createDataFrame([("A", w(1)), ("A", w(1)), ("D", None), (None, None)], "node_id string, text string").withColumn("attributes", F.from_json("text", GIVEN))
    found = {(r.node_id, r.listed, len(r.flat)) for r in payload.nodes(listed, edges).collect()}
    assert found == {("A", True, 1), ("D", True, 0), ("B", False, 0), ("C", False, 0)}
    empty = edges.limit(0)
    assert payload.placed(empty).count() == payload.collapsed_full(payload.placed(empty)).count() == payload.nodes(listed.limit(0), empty).count() == 0


def test_graph_forms_flatten_each_edge_once(spark, sf):
    """all forms read one stored table, none goes back to the tables of the edges."""
    from kgloom import plan_queries

    read = plan_queries.q142_graph_forms(spark, sf).inputFiles()
    assert read and not [f for f in read if sf in f]


def test_undirected_rows_equal_those_placed_so(spark):
    edges = spark.sql("""select e as edge_id, e as pos, s as subject, o as object, 'p' as predicate,
      array(struct('w' as original_attribute_name, 'x' as attribute_type_id, parse_json('2') as value)) as attributes from values ('1', 'b', 'a'), ('2', 'a', 'b'), ('3', null, 'a') t(e, s, o)""")
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(payload.undirected(payload.placed(edges, True, "w"))) == plain(payload.placed(edges, False, "w"))


def test_attributes_are_walked_once(spark):
    """a key's value walked the attributes again, five times a key."""
    rows = [("e1", 1, "A", "B", "p", _text(("w", "x", 1), (None, None, 2), ("", None, 3), ("attr_1", None, 4), ("w", "y", [5]), (None, "w", "six")), ""), ("e2", 2, "A", "B", "p", _text(("a", "x", None)), ""), ("e3", 3, "A", "B", "p", None, "")]
    flat = _given(spark, rows).select("edge_id", payload.flattened(F.col("attributes")).alias("flat"))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    found = {r.edge_id: {k: json.loads(v) for k, v in r.flat.items()} for r in flat.collect()}
    assert found == {"e1": {"w": [1, [5], "six"], "attr_1": [2, 4], "attr_2": 3}, "e2": {"a": None}, "e3": {}}


def test_forms_of_an_edge_are_collapsed_after_one_shuffle(spark):
    rows = [("e1", 1, "A", "B", "p", 1.0), ("e2", 2, "A", "B", "p", None), ("e3", 3, "A", "B", "p", 8.0), ("e4", 4, "B", "C", "p", 3.0), ("e5", 5, "D", "D", "p", None)]
    multi = spark.createDataFrame(rows, "id string, pos long, u string, v string, predicate string, weight double")
    forms = {f"by_{how}": (how, F.col("weight") * 2) for how in ("sum", "max", "min", "first", "mean")}
    found = payload.collapsed_forms(multi, forms)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    got = {(r.u, r.v): r.asDict() for r in found.collect()}
    for how in ("sum", "max", "min", "first", "mean"):
        each = payload.collapsed_weights(multi.withColumn("weight", F.col("weight") * 2), how)
        assert {(r.u, r.v): r.weight for r in each.collect()} == {k: r[f"by_{how}"] for k, r in got.items()}
    assert got["A", "B"]["by_sum"] == 18.0 and got["A", "B"]["by_mean"] == 8.5 and got["D", "D"]["by_max"] is None
