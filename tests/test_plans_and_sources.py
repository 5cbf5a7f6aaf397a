import json

import pytest
from pyspark.sql import functions as F

from kgloom.functions import scalars
from kgloom.plans import planner
from kgloom.sources import messages

CREATIVE = {"nodes": {"drug": {"categories": ["biolink:Drug"]}, "illness": {"ids": ["DISEASE:77"]}}, "edges": {"e": {"subject": "drug", "object": "illness", "predicates": ["biolink:treats"], "knowledge_type": "inferred"}}}


def test_examining_queries():
    assert planner.examine(CREATIVE) == {"infer": True, "pathfinder": False, "question": "illness", "answer": "drug"}
    assert planner.examine({"nodes": {}, "paths": {"p": {}}})["pathfinder"]
    with pytest.raises(ValueError):
        planner.examine({"nodes": {"a": {"ids": ["x"]}, "b": {"ids": ["y"]}}, "edges": {"e": {"subject": "a", "object": "b", "knowledge_type": "inferred"}}})


def test_equivalent_queries_have_one_text():
    other = json.loads(json.dumps(CREATIVE))
    other["nodes"]["drug"]["is_set"] = False
    other["edges"]["e"] |= {"predicates": ["biolink:treats_or_applied_or_studied_to_treat"], "attribute_constraints": []}
    assert planner.canonical(CREATIVE) == planner.canonical(other)


def test_rules_expand_a_query():
    rule = {"nodes": {"$source": {"ids": ["$source_id"]}, "$target": {"ids": ["$target_id"]}, "g": {}}, "edges": {}}
    first, second = planner.expand(CREATIVE, {planner.rule_key(CREATIVE["edges"]["e"]): [rule]})
    assert "knowledge_type" not in first["edges"]["e"]
    assert second["nodes"] == {"drug": {}, "illness": {"ids": ["DISEASE:77"]}, "g": {}}


def test_workflows():
    assert planner.workflow(CREATIVE)[0] == "lookup"
    assert planner.workflow(CREATIVE, ["own"]) == ["own"]


def test_messages_round_trip(spark, tmp_path):
    body = {"message": {"knowledge_graph": {"nodes": {"A": {"name": "a", "categories": ["x"]}}, "edges": {"e1": {"subject": "A", "object": "B", "predicate": "p", "attributes": [{"attribute_type_id": "biolink:support_graphs", "value": ["aux1"]}]}}}, "results": [{"node_bindings": {"n": [{"id": "A"}]}, "analyses": [{"score": 0.9}, {}]}], "auxiliary_graphs": {"aux1": {"edges": ["e2"]}}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1.json").write_text(json.dumps(body))
    messages.save(messages.read_json(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    m = messages.load(spark, str(tmp_path / "out"))
    assert [(r.message_id, r.node_id, r.name) for r in messages.nodes(m).collect()] == [("m1", "A", "a")]
    assert [r.score for r in messages.analyses(m).orderBy("pos").collect()] == [0.9, 0.0]
    assert [(r.edge_id, r.aux_id) for r in messages.supports(m).collect()] == [("e1", "aux1")]
    assert [(r.aux_id, r.edge_id) for r in messages.aux_graphs(m).collect()] == [("aux1", "e2")]
    assert [r.knode for r in messages.node_bindings(m).collect()] == ["A"]


def test_scalars(spark):
    df = spark.createDataFrame([("500ms", "1.5Ki", "10-2"), ("2h", "7MB", "10"), (None, "bad", "10-x"), ("7", "", "a-b-4")], "d string, s string, i string")
    rows = df.select(scalars.duration_seconds(F.col("d")), scalars.size_bytes(F.col("s")), scalars.next_stream_id(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1536, "10-3"), (7200.0, 7000000, "10-1"), (0.0, 0, "10-x"), (7.0, 0, "a-b-4")]
    assert scalars.choose_bucket(60) == 30 and scalars.choose_bucket(86400) == 600 and scalars.choose_bucket(1e9) == 86400
