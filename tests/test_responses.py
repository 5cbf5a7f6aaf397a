"""The operators behind the response, path and plan queries, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from kgloom.operators import graphs, overlay, pathfinder, response, scoring
from kgloom.plans import tables


def test_answers_merge_creatives_first(spark):
    rows = [("a", 2, 1, "n2", "e1", True), ("a", 1, 1, "n1", "e2", False), ("a", 1, 2, "n2", "e2", False), ("a", 4, 1, "n3", "e3", True), ("b", 3, 1, "n1", "e4", False)]
    df = spark.createDataFrame(rows, "on_ string, result_id long, pos int, sn string, kedge_id string, creative boolean")
    found = {r.answer: (r.nodes, r.aux_ids, r.lookup_edges, r.synthetic_edge) for r in response.merged_answers(df, "treats").collect()}
    assert found == {"a": (["n2", "n3", "n1"], ["AUX:2", "AUX:4"], ["e2"], "treats|a"), "b": (["n1"], [], ["e4"], None)}
    assert {(r.aux_id, tuple(r.edges)) for r in response.support_graphs(df).collect()} == {("AUX:2", ("e1",)), ("AUX:4", ("e3",))}


def test_probes_are_the_nodes_of_lowest_degree(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "b"), (2, "x", "y"), (3, "a", "b"), (3, "b", "a"), (3, "b", "c"), (3, "c", "d"), (3, "c", "b")], "result_id long, u string, v string")
    found = {}
    for r in response.probes(df).collect():
        found.setdefault(r.result_id, set()).add(r.node)
    # in graph 3, d is alone at degree 1, and a is the next at 2
    assert found == {1: {"a", "c"}, 2: {"x", "y"}, 3: {"a", "d"}}


def test_result_graph_joins_all_query_nodes_of_an_end(spark):
    edges = spark.createDataFrame([("e", "n1", "n2")], "edge_id string, subject string, object string")
    bound = spark.createDataFrame([(1, "q0", "n1"), (1, "q1", "n2"), (1, "q2", "n2"), (2, "q0", "n1")], "result_id long, qnode string, knode string")
    own = spark.createDataFrame([(1, 1, "e"), (2, 1, "e")], "result_id long, pos int, kedge_id string")
    assert sorted((r.result_id, r.subject_q, r.object_q) for r in response.result_graph(own, bound, edges).collect()) == [(1, "q0", "q1"), (1, "q0", "q2")]


def test_paths_need_two_ends():
    g = pathfinder.builder("A:1", "B:2", ["p"], "thing")
    assert [(e["subject"], e["object"]) for e in g["edges"].values()] == [("source", "first"), ("first", "second"), ("second", "target")]
    assert g["nodes"]["first"] == {"categories": ["thing"]}
    with pytest.raises(ValueError):
        pathfinder.builder("A:1", "A:1")


def test_ranks_by_range(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("score"))
    found = [(r.rank, r.id) for r in pathfinder.ranked(df, F.desc("score"), "id").orderBy("rank").collect()]
    assert found == list(enumerate((i for i in sorted(range(500), key=lambda i: (-(i * 37 % 101), i))), 1))


def test_normalizers_take_any_attribute(spark):
    rows = [("jaccard_index", "0.5"), ("Genetics-quantile", "0.3"), ("CMAP similarity score", "-50"), ("feature_coefficient", "0"), ("pValue", "0"), ("probability", "no value!"), ("probability", "nan"), ("who knows", "1")]
    df = spark.createDataFrame(rows, "name string, text string")
    found = [round(r.s, 6) for r in df.select(scoring.dispatched(F.col("name"), F.col("text"), F.lit(0.8)).alias("s")).collect()]
    assert found == [0.625, 0.3, 0.5, 0.0, 1.0, 0.0, 0.0, -1.0]


def test_overlay_stops_at_too_many_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")], "result_id long, node_id string")
    assert {(r.result_id, r.a, r.b, r.shared, r.n_a, r.n_b) for r in overlay.overlaid(df).collect()} == {(1, "a", "b", 2, 2, 2), (1, "a", "c", 1, 2, 1), (1, "b", "c", 1, 2, 1), (2, "a", "b", 2, 2, 2)}
    assert overlay.overlaid(df, most=3).count() == 0


def test_edges_touching_nodes_come_once(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "a", "a")], "edge_id string, subject string, object string")
    top = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert sorted(r.edge_id for r in graphs.touching(e, top).collect()) == ["1", "2", "4"]


def test_a_query_without_one_pinned_end_is_an_error(spark):
    df = spark.createDataFrame([("q", ["a"], ["b"], "p", None, None, True)], "query_id string, subject_ids array<string>, object_ids array<string>, predicate string, aspect string, direction string, inferred boolean")
    with pytest.raises(Exception, match="one pinned node"):
        tables.examined(df).collect()
