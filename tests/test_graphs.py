import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from kgloom.operators import graphs, lookup, results


def test_resistance_of_two_nodes_and_of_a_chain():
    two = np.array([[1.0, -1.0], [-1.0, 1.0]])
    assert graphs.effective_resistance(two, [(0, 1)]) == pytest.approx(np.exp(-1))
    chain = np.array([[2.0, -2, 0], [-2, 4, -2], [0, -2, 2]])
    assert graphs.effective_resistance(chain, [(0, 2)]) == pytest.approx(np.exp(-1))


def test_flow_takes_all_ways():
    a = np.zeros((4, 4))
    a[0, 1], a[0, 2], a[1, 3], a[2, 3], a[1, 2] = 3, 2, 2, 3, 1
    assert graphs.max_flow(a, 0, 3) == pytest.approx(5)


def test_scores_of_a_node_alone():
    g = pd.DataFrame({"u": ["a"], "v": ["a"], "w": [0.5]})
    assert graphs.max_flow_score(g) == 1.0
    assert graphs.longest_path_score(g) == 1.0


def test_pagerank_prefers_the_seed_of_a_cycle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("A", "B")], "subject string, object string")
    rank = {r.node_id: r.r for r in graphs.pagerank(edges, spark.createDataFrame([("A",)], "node_id string"), 60).collect()}
    assert max(rank, key=rank.get) == "A"
    assert sum(rank.values()) == pytest.approx(1.0)


def test_support_closure_ends_in_a_cycle_and_passes_over_dangling_references(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    supports = spark.createDataFrame([("e1", "x"), ("e2", "y"), ("e3", "gone")], "edge_id string, aux_id string")
    aux = spark.createDataFrame([("x", "e2"), ("y", "e1"), ("y", "e3")], "aux_id string, edge_id string")
    found = graphs.support_closure(spark.createDataFrame([("e1",)], "edge_id string"), supports, aux)
    assert {(r.edge_id, r.depth) for r in found.collect()} == {("e1", 0), ("e2", 1), ("e3", 2)}


def test_support_closure_follows_a_chain_to_its_end(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 35
    supports = spark.createDataFrame([(f"e{k}", f"x{k}") for k in range(n)], "edge_id string, aux_id string")
    aux = spark.createDataFrame([(f"x{k}", f"e{k + 1}") for k in range(n)], "aux_id string, edge_id string")
    found = graphs.support_closure(spark.createDataFrame([("e0",)], "edge_id string"), supports, aux)
    assert {(r.edge_id, r.depth) for r in found.collect()} == {(f"e{k}", k) for k in range(n + 1)}


def test_collapsing_a_multigraph(spark):
    e = spark.createDataFrame([("1", "a", "b", 0.5), ("2", "a", "b", 0.25), ("3", "a", "b", 1.0)], "edge_id string, subject string, object string, w double")
    for how, want in {"sum": 1.75, "max": 1.0, "min": 0.25, "first": 0.5, "mean": 0.6875}.items():
        assert graphs.collapsed(e, e["w"], how).first().w == pytest.approx(want)


def test_promiscuous_query_node(spark):
    rows = [(1, 0, "a", "c", "p", None), (1, 1, "b", "c", "p", None), (1, 2, "a", "d", "q", None)]
    e = spark.createDataFrame(rows, "query_id int, pos int, subject string, object string, predicates string, qualifiers string")
    assert [r.qnode for r in results.promiscuous_qnodes(e).collect()] == ["c"]


def test_a_query_graph_must_be_connected(spark):
    e = spark.createDataFrame([("1", "a", "b", "p")], "edge_id string, subject string, object string, predicate string")
    n = spark.createDataFrame([("a", "k", "x", "y")], "node_id string, kind string, cat1 string, cat2 string")
    graph = {"nodes": {k: {} for k in "abcd"}, "edges": {"x": {"subject": "a", "object": "b"}, "y": {"subject": "c", "object": "d"}}}
    with pytest.raises(ValueError):
        lookup.match(graph, n, e)


def test_edges_of_weight_0_are_hops():
    """a chain whose second edge weighs nothing still ends at s, so no flow and no walk reach it."""
    g = pd.DataFrame({"u": ["c", "p"], "v": ["p", "s"], "w": [0.2, 0.0]})
    assert graphs.max_flow_score(g) == 0.0
    assert graphs.longest_path_score(g) == 0.0
    assert graphs.max_flow_score(g.assign(w=[0.2, 0.1])) == pytest.approx(0.1)


def test_few_ranks_leave_the_links_where_they_are(spark, monkeypatch):
    sizes, step = [], graphs.step

    def counted(df, name):
        out = step(df, name)
        if name == "ranks":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graphs, "step", counted)
    edges = spark.createDataFrame([("A", "B"), ("B", "C")] + [(f"x{i}", f"y{i}") for i in range(40)], "subject string, object string")
    both = []
    for few in (graphs.FEW, 0):
        monkeypatch.setattr(graphs, "FEW", few)
        both.append({r.node_id: r.r for r in graphs.pagerank(edges, spark.createDataFrame([("A",)], "node_id string"), 3).collect()})
    assert both[0] == both[1] and len(both[0]) == 83 and both[0]["x1"] == 0.0 and max(sizes) <= 3
    assert abs(sum(both[0].values()) - 1.0) < 1e-12


@pytest.mark.parametrize("few", [0, 500_000])
def test_hops_store_each_edge_once(spark, monkeypatch, few):
    """the ends were stored in both directions, distinct, and joined by a shuffle a hop."""
    monkeypatch.setattr(lookup, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (50, 2)).tolist()] + [("n1", "n2")] * 3 + [("n5", "n5")]
    stored, step = [], lookup.step
    monkeypatch.setattr(lookup, "step", lambda df, name: stored.append((name, df.count())) or step(df, name))
    found = lookup.k_hop(spark.createDataFrame(rows, "subject string, object string"), spark.createDataFrame([("n1",), ("n5",), ("n1",), ("away",)], "node string"), 3)
    hops, frontier = {n: 0 for n in ("n1", "n5", "away")}, {"n1", "n5", "away"}
    for hop in (1, 2, 3):
        frontier = {b for a, b in rows + [(o, s) for s, o in rows] if a in frontier} - set(hops)
        hops |= dict.fromkeys(frontier, hop)
    assert sorted(map(tuple, found.collect())) == sorted(hops.items()) and max(hops.values()) == 3
    assert stored[0] == ("ends", len(rows)) and {n for n, _ in stored[1:]} == {"hop"}


def _least_cut(a, s, t):
    others = [x for x in range(len(a)) if x not in (s, t)]
    sides = ({s, *(x for i, x in enumerate(others) if m >> i & 1)} for m in range(2 ** len(others)))
    return min(sum(a[i, j] for i in side for j in range(len(a)) if j not in side) for side in sides)


def test_flows_of_many_graphs_equal_least_cuts():
    rng = np.random.default_rng(4)
    for n in (2, 4, 6):
        a = np.where(rng.random((40, n, n)) < 0.45, rng.integers(0, 5, (40, n, n)), 0).astype(float)
        s, t = rng.integers(0, n, 40), rng.integers(1, n, 40)
        t = (s + t) % n
        assert graphs.max_flows(a, s, t).tolist() == pytest.approx([_least_cut(a[i] * (1 - np.eye(n)), s[i], t[i]) for i in range(40)])


def _hops(wired, i, j):
    seen, hops = {i}, 0
    while j not in seen:
        more = seen | {int(v) for u in seen for v in np.flatnonzero(wired[u])}
        if more == seen:
            return -1
        seen, hops = more, hops + 1
    return hops


@pytest.mark.parametrize("cells", [50, 4_000_000])
def test_stacked_scores_equal_those_of_each_graph(spark, monkeypatch, cells):
    """F2: graphs of one size are scored together, and rows that lie by result aren't shuffled again."""
    rng = np.random.default_rng(6)
    rows = [(g, f"n{u}", f"n{v}", float(w) / 10) for g in range(40) for u, v, w in rng.integers(0, (2 + g % 5, 2 + g % 5, 10), (1 + g % 7, 3)).tolist()]
    expected = {"max_flow": {}, "longest_path": {}}
    for g in range(40):
        names, a, wired = graphs._matrix(pd.DataFrame([r[1:] for r in rows if r[0] == g], columns=["u", "v", "w"]))
        n = len(names)
        d = np.array([[_hops(wired, i, j) for j in range(n)] for i in range(n)])
        far = [(i, j) for i in range(n) for j in range(n) if d[i, j] == d.max()]
        flows = [_least_cut(a, i, j) for i, j in far if i != j]
        walks = np.linalg.matrix_power(a, d.max()) / float(np.prod(range(1, d.max() + 1)))
        expected["max_flow"][g] = 1.0 if n == 1 else 1 - np.prod([1 - x for x in flows]) if d.max() else 0.0
        expected["longest_path"][g] = 1 - np.prod([1 - walks[i, j] for i, j in far])
    monkeypatch.setattr(graphs, "CELLS", cells)
    edges = spark.createDataFrame([*rows, (None, "a", "b", 1.0)], "result_id long, u string, v string, w double").repartition(3, "result_id")
    g, u, v, w = (list(x) for x in zip(*rows, strict=True))
    for name, want in expected.items():
        here = graphs._stacked(np.array(g), pa.array(u), pa.array(v), np.array(w), 40, getattr(graphs, f"{name}_scores"))  # tasks don't see the smaller limit
        assert dict(enumerate(here)) == pytest.approx(want)
        found = graphs.score_stacked(edges, getattr(graphs, f"{name}_scores"), places=9)
        assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
        assert {r.result_id: r.score for r in found.collect()} == pytest.approx(want, abs=1e-8)
