"""Tasks keep their size when tables grow."""

import pytest

from kgloom.operators import overlay, pathfinder, response
from kgloom.sources import star


def test_a_task_gets_as_many_rows_of_a_larger_table(spark, sf, monkeypatch):
    lines = star.table(spark, sf, "lineitem").count()
    whole = sorted(map(tuple, star.analyses(spark, sf).collect())), sorted(map(repr, star.kg_edges(spark, sf).collect()))
    monkeypatch.setattr(star, "LEAST_ROWS", 1_000_000)
    for rows in (lines, 500):
        monkeypatch.setattr(star, "TASK_ROWS", rows)
        own = star.analyses(spark, sf)
        assert own.rdd.getNumPartitions() == -(-lines // rows)
        assert star.supplies(spark, sf).rdd.getNumPartitions() == -(-lines // rows)
        assert (sorted(map(tuple, own.collect())), sorted(map(repr, star.kg_edges(spark, sf).collect()))) == whole


@pytest.mark.parametrize("rows, parts", [(0, 1), (19_999, 1), (200_001, 4), (36_000_000, 180)])
def test_parts_for(spark, rows, parts):
    assert star.parts_for(spark, rows) == parts


def test_pairs_of_results_keep_the_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(star, "TASK_ROWS", 500)
    members = star.analyses(spark, sf).select("result_id", star.F.col("sn").alias("node_id"))
    plan = overlay.pairs(members)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan and "hashpartitioning(result_id" not in plan


@pytest.mark.parametrize("few", [0, 10])
def test_paths_meet_whole_edges_in_one_pass(spark, monkeypatch, few):
    monkeypatch.setattr(pathfinder, "FEW", few)
    rows = [("a", "x", "p"), ("y", "a", "q"), ("x", "z", "p"), ("z", "y", "r"), ("z", "b", "p"), ("x", "y", "p"), ("y", "b", "s"), (None, "x", "p"), ("a", "b", "p"), ("u", "v", "p")]
    edges = spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], "edge_id string, subject string, object string, predicate string")
    nodes = spark.createDataFrame([(n, n.upper()) for n in "abuvxyz"], "node_id string, name string")
    found = pathfinder.linearized(edges, nodes, "a", "b")
    assert sorted((r.n1, r.n2) for r in found.collect()) == [("x", "y"), ("x", "z"), ("y", "z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and ("strategy=broadcast" in plan) == (few > 0)


def test_result_graphs_are_joined_in_counted_parts(spark, sf):
    rows = spark.createDataFrame([(i, p, f"e{p}") for i in range(20) for p in range(3)], "result_id long, pos int, kedge_id string")
    nodes = spark.createDataFrame([(i, q, f"n{k}") for i in range(20) for k in range(4) for q in ("a", "b")[: k % 2 + 1]] * 2, "result_id long, qnode string, knode string")
    edges = spark.createDataFrame([(f"e{p}", f"n{p}", f"n{p + 1}") for p in range(3)], "edge_id string, subject string, object string")
    found = response.result_graph(rows, nodes, edges, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x) and "REPARTITION_BY_NUM" in plan
    own = sorted(map(tuple, found.collect()))
    assert len(own) == 20 * (2 + 2 + 2) and own == sorted(map(tuple, response.result_graph(rows, nodes, edges).collect()))


@pytest.mark.parametrize("few", [0, 500_000])
def test_names_of_ends_are_joined_by_keys(spark, sf, tmp_path, monkeypatch, few):
    monkeypatch.setattr(star, "FEW", few)
    for name in ("customer", "supplier", "part", "orders", "lineitem", "nation", "region"):
        rows = star.table(spark, sf, name)
        if name in ("customer", "supplier", "part"):  # a key without a row, one with two, one with a null name
            key, text = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}[name]
            rows = rows.where(f"{key} <> 2").union(rows.where(f"{key} = 3")).withColumn(text, star.F.expr(f"if({key} = 4, null, {text})"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    nodes = star.kg_nodes(spark, str(tmp_path)).select("node_id", "name")
    s, o = nodes.toDF("subject", "subject_name"), nodes.toDF("object", "object_name")
    whole = star.kg_edges(spark, str(tmp_path)).join(s, "subject").join(o, "object").select("edge_id", "subject_name", "object_name")
    found = star.named_edges(spark, str(tmp_path))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(concat" not in plan and "hashpartitioning(subject" not in plan
