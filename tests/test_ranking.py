"""Rankers' operators against brute force: resistance, closure, ranks, neighbourhoods, removal in rounds."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import ranking_queries
from kgloom.operators import graphs, neighbourhood, resistance, results
from kgloom.sources import star

EDGES, PROBES = "result_id long, u string, v string, g double", "result_id long, node string"


def _laplacian(edges):
    names = sorted({x for u, v, _ in edges for x in (u, v)})
    m = np.zeros((len(names), len(names)))
    for u, v, g in edges:
        i, j = names.index(u), names.index(v)
        m[i, i] += g
        if i != j:
            m[j, j] += g
            m[i, j] -= g
            m[j, i] -= g
    return names, m


def _score(edges, probes):
    probes = sorted(set(probes))
    if len(probes) < 2:
        return -1.0
    names, m = _laplacian(edges)
    if any(p not in names for p in probes):
        return 0.0
    total = 0.0
    for a, b in combinations(probes, 2):
        d = np.zeros(len(names))
        d[names.index(a)], d[names.index(b)] = 1, -1
        total += d @ np.linalg.lstsq(m, d, rcond=None)[0]
    return float(np.exp(-total))


def test_resistance_of_random_graphs_equals_their_matrices(spark):
    rng = np.random.default_rng(4)
    graphs_, probes = {}, {}
    for i in range(40):
        n = int(rng.integers(2, 9))
        own = [(f"n{a}", f"n{b}", float(rng.uniform(0.1, 3))) for a in range(n) for b in range(a, n) if rng.random() < (0.08 if a == b else 0.35)]
        graphs_[i] = own + own[:1]  # parallel edges add
        probes[i] = [f"n{k}" for k in rng.choice(n, min(n, int(rng.integers(1, 5))), replace=False)]
    graphs_[100], probes[100] = [("a", "b", 1.0), ("c", "d", 2.0), ("d", "e", 1.0)], ["a", "c"]  # no way between them
    graphs_[101], probes[101] = [("a", "b", 1.0)], ["a", "gone"]
    graphs_[102], probes[102] = [("a", "b", 1.0), ("b", "c", 1.0)], ["a", "b", "c"]
    e = spark.createDataFrame([(i, *x) for i, own in graphs_.items() for x in own], EDGES)
    p = spark.createDataFrame([(i, x) for i, own in probes.items() for x in own], PROBES)
    found = {r.result_id: r.score for r in resistance.scores(e, p).collect()}
    assert found == pytest.approx({i: _score(graphs_[i], probes[i]) for i in graphs_}, abs=1e-9)
    assert found[102] == pytest.approx(np.exp(-4))  # 1 + 1 + 2


def test_small_and_large_graphs_are_scored_by_the_same_steps(spark):
    """a graph beyond what a task holds goes over its edge table, beside small ones that take one shuffle."""
    wide = [x for i in range(150) for x in ((f"n{i}", "s", 1.0), (f"n{i}", "t", 1.0))]
    own = {1: wide, 2: [("a", "b", 1.0), ("c", "d", 2.0), ("c", "c", 0.5)], 3: [("a", "a", 1.0), ("b", "b", 0.5)], 4: [("a", "b", 1.0)]}
    probes = {1: ["s", "t"], 2: ["a", "c"], 3: ["a", "b"], 4: ["a"]}
    e = spark.createDataFrame([(i, *x) for i, g in own.items() for x in g], EDGES)
    p = spark.createDataFrame([(i, x) for i, g in probes.items() for x in [*g, g[0]]], PROBES)
    found = {r.result_id: r.score for r in resistance.scores(e, p).collect()}
    assert found == pytest.approx({1: np.exp(-1 / 75), **{i: _score(own[i], probes[i]) for i in (2, 3, 4)}}, abs=1e-9)
    assert resistance.SMALL < len(wide)


def test_matrix_score_takes_all_pairs_of_probes():
    import pandas as pd

    g = pd.DataFrame({"u": ["a", "b", "a", "b", "c"], "v": ["b", "c", "a", "b", "c"], "w": [1.0, 1, 0, 0, 0], "probe": [False, False, True, True, True]})
    assert graphs.resistance_score(g) == pytest.approx(np.exp(-4))


def test_nodes_of_a_result_stand_for_query_nodes_and_support_nodes(spark):
    bindings = spark.createDataFrame([(1, "q0", "A"), (1, "q1", "B"), (1, "q2", "A")], "result_id long, qnode string, knode string")
    kg = spark.createDataFrame([("e1", "A", "B"), ("e2", "B", "C"), ("e3", "C", "D")], "edge_id string, subject string, object string")
    nodes = spark.createDataFrame([(1, "A"), (1, "C")], "result_id long, node_id string")
    edges = spark.createDataFrame([(1, "e1"), (1, "e2"), (1, "e3"), (1, "gone"), (1, "e1")], "result_id long, edge_id string")
    found = resistance.rnode_edges(edges, nodes, bindings, kg)
    assert sorted(tuple(r)[1:] for r in found.select("result_id", "u", "v", "edge_id").collect()) == [("q0", "q1", "e1"), ("q1", "support_node_C", "e2"), ("q2", "q1", "e1")]
    admittances = spark.createDataFrame([("e1", 2.0), ("e2", 1.0)], "edge_id string, admittance double")
    asked = spark.createDataFrame([(1, "q1", "q0"), (1, "q0", "q2")], "result_id long, u string, v string")
    g = {(r.u, r.v): r.g for r in resistance.conductances(found, admittances, asked, 0.5).collect()}
    assert g == pytest.approx({("q0", "q1"): 2.5, ("q1", "q2"): 2.0, ("q1", "support_node_C"): 1.0, ("q0", "q2"): 0.5})


def _closed(spark, bound, edges, supports=(), aux_edges=(), aux_nodes=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    e, n = graphs.ranker_closure(
        make(bound, "result_id long, edge_id string"), make(edges, "edge_id string, subject string, object string, described boolean"),
        make(supports, "edge_id string, aux_id string"), make(aux_edges, "aux_id string, edge_id string"), make(aux_nodes, "aux_id string, node_id string"),
    )
    by = lambda df: {i: {r[1] for r in df.collect() if r[0] == i} for i in {b[0] for b in bound}}
    return by(e), by(n)


def test_closure_of_a_ranker(spark):
    edges = [("e1", "A", "B", True), ("e2", "B", "C", True), ("e3", "C", "D", False), ("e4", "D", "E", True), ("plain", "X", "Y", False), ("end", None, "Z", True)]
    supports = [("e1", "x"), ("e2", "y"), ("e3", "z"), ("e1", "missing"), ("plain", "z"), ("e4", "x")]
    aux_edges = [("x", "e2"), ("x", "nowhere"), ("y", "e3"), ("y", "e1"), ("z", "e4")]
    aux_nodes = [("x", "EXTRA"), ("z", "NEVER")]
    e, n = _closed(spark, [(1, "e1"), (2, "plain"), (3, "unknown"), (4, "e4"), (4, "plain"), (5, "end")], edges, supports, aux_edges, aux_nodes)
    # e3 is reached, but doesn't lead on; e1 and e2 support each other
    assert e[1] == {"e1", "e2", "e3"} and n[1] == {"A", "B", "C", "D", "EXTRA"}
    assert (e[2], n[2]) == ({"plain"}, set()) and (e[3], n[3]) == ({"unknown"}, set())
    assert e[4] == {"e4", "plain", "e2", "e3", "e1"} and n[4] == {"D", "E", "B", "C", "A", "EXTRA"}
    assert (e[5], n[5]) == ({"end"}, {"Z"})


def test_a_closure_walks_over_support_graphs_not_over_their_edges(spark, monkeypatch):
    sizes, step = [], graphs.step

    def counted(df, name):
        out = step(df, name)
        if name == "walk":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graphs, "step", counted)
    many = [f"m{i}" for i in range(50)]
    edges = [(e, "A", "B", True) for e in ["e", *many]]
    found, nodes = _closed(spark, [(1, "e"), (2, "e")], edges, [("e", "x"), ("m7", "y")], [("x", m) for m in many] + [("y", "e")], [("y", "Q")])
    assert found == {i: {"e", *many} for i in (1, 2)} and nodes == {i: {"A", "B", "Q"} for i in (1, 2)}
    assert max(sizes) <= 2


def test_wires_of_results_are_made_after_one_shuffle(spark):
    """as ``conductances`` of ``rnode_edges``, which shuffle edges, nodes and bindings apart."""
    rng = np.random.default_rng(5)
    kg = {f"e{i}": (f"n{rng.integers(8)}", f"n{rng.integers(8)}", float(rng.integers(1, 9))) for i in range(40)} | {"lost": (None, None, None)}
    rows = [(int(r), e, *kg[e][:2], bool(rng.integers(2)), kg[e][2]) for r in range(6) for e in rng.choice(sorted(kg), 12).tolist()]
    rows += [(0, None, "n1", None, True, None), (1, None, "far", None, True, None), (9, "e1", *kg["e1"][:2], True, kg["e1"][2])]
    binds = {0: {"a": ["n0", "n1"], "b": ["n1"]}, 1: {"a": ["n2"], "b": ["n2"]}, 2: {"a": ["n7"], "b": []}, 3: {"a": ["n3"]}, 4: {"b": ["n4", "n5"]}, 7: {"a": ["n0"]}}
    table = spark.createDataFrame(rows, "result_id long, edge_id string, subject string, object string, gives boolean, admittance double")
    bound = spark.createDataFrame(list(binds.items()), "result_id long, binds map<string,array<string>>")
    found = resistance.wired(table, bound, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    bindings = spark.createDataFrame([(r, q, k) for r, own in binds.items() for q, ks in own.items() for k in ks], "result_id long, qnode string, knode string")
    nodes = table.where("gives").select("result_id", F.explode(F.array("subject", "object")).alias("node_id")).where("node_id is not null")
    known = spark.createDataFrame([(e, s, o, g) for e, (s, o, g) in kg.items() if g], "edge_id string, subject string, object string, admittance double")
    none = spark.createDataFrame([], "result_id long, u string, v string")
    whole = resistance.conductances(resistance.rnode_edges(table.where("edge_id is not null"), nodes, bindings, known), known.select("edge_id", "admittance"), none, 1.0)
    got, want = ({(r.result_id, r.u, r.v): r.g for r in df.collect()} for df in (found, whole))
    assert got == pytest.approx(want) and len(got) > 40 and (9, *sorted(f"support_node_{x}" for x in kg["e1"][:2])) in got


def test_scores_of_result_graphs_equal_matrices(spark, sf):
    found = {r.result_id: r.score for r in ranking_queries.q134_result_graph_scores(spark, sf).collect()}
    bound, edges, supports, aux_edges, aux_nodes = ([tuple(r) for r in df.collect()] for df in ranking_queries._closure(spark, sf))
    kg, leads = {e: (s, o) for e, s, o, _ in edges}, {e for e, _, _, d in edges if d}
    of, holds, names = defaultdict(set), defaultdict(set), defaultdict(set)
    for target, rows in ((of, supports), (holds, aux_edges), (names, aux_nodes)):
        for a, b in rows:
            target[a].add(b)
    papers = {r.edge_id: r.num_publications for r in star.supplies(spark, sf).collect()}
    bindings, of_result = defaultdict(set), defaultdict(set)
    for r in star.analyses(spark, sf).collect():
        bindings[r.result_id] |= {("sn", r.sn), ("on", r.on_)}
    for i, e in bound:
        of_result[i].add(e)
    admit = lambda w: -1 / np.log(w)
    expected = {}
    for i, own in of_result.items():
        reached, queue, nodes = set(own), [e for e in own if e in leads], set()
        walked = set(queue)
        for e in queue:
            nodes |= set(kg[e])
            if e in leads:
                for x in of[e]:
                    nodes |= names[x]
                    new = [t for t in holds[x] if t in kg and t not in walked]
                    walked |= set(new)
                    queue += new
                    reached |= set(new)
        stands = defaultdict(set)
        for q, k in bindings[i]:
            stands[k].add(q)
        for x in nodes:
            if x not in stands:
                stands[x].add(f"support_node_{x}")
        wires = {(min(u, v), max(u, v), e) for e in reached for u in stands[kg[e][0]] for v in stands[kg[e][1]]}
        rows = [(u, v, admit(0.01) + admit(-1 + 2 / (1 + np.exp(-0.574213221 * papers[e])))) for u, v, e in wires] + [("on", "sn", admit(1e-3))]
        expected[i] = round(_score(rows, ["on", "sn"]) + 1e-9, 6)
    assert found == pytest.approx(expected, abs=2e-6) and len({round(x, 3) for x in expected.values()}) > 20


def _ranked(links, targets, tolerance=1e-2, most=100):
    names = sorted({x for e in links for x in e})
    out = Counter(s for s, _ in set(links))
    goal = [x for x in names if x in targets] or names
    p = {x: (x in goal) / len(goal) for x in names}
    r = dict.fromkeys(names, 1 / len(names))
    for step in range(most):
        lost = sum(r[x] for x in names if not out[x])
        new = {x: 0.85 * lost * p[x] + 0.15 * p[x] for x in names}
        for s, o in set(links):
            new[o] += 0.85 * r[s] / out[s]
        error, r = sum(abs(new[x] - r[x]) for x in names), new
        if error < len(names) * tolerance:
            break
    return r, step + 1


def _graphs(seed=8, n=6):
    rng = np.random.default_rng(seed)
    links = {f"g{q}": [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 4 + 5 * q, (6 + 20 * q, 2)).tolist()] for q in range(n)}
    return links, {"g0": ["n0"], "g1": ["n1", "n2", "absent"], "g2": ["absent"], "g3": ["n3"], "g5": ["n0", "n0"]}


def test_ranks_of_many_queries_at_once(spark, monkeypatch):
    links, targets = _graphs()
    steps = {q: _ranked(own, targets.get(q, []))[1] for q, own in links.items()}
    rows, real, going = [(q, *e) for q, own in links.items() for e in own], neighbourhood.step, []

    def step(df, name):
        out = real(df, name)
        if name == "open":
            going.append({r.query for r in out.collect()})
        return out

    monkeypatch.setattr(neighbourhood, "step", step)
    found = neighbourhood.personal_ranks(spark.createDataFrame(rows, "query string, subject string, object string"), spark.createDataFrame([(q, x) for q, own in targets.items() for x in own], "query string, node_id string"), tolerance=1e-2, hub=1)
    got = {(r.query, r.node_id): r.r for r in found.collect()}
    assert got == pytest.approx({(q, x): r for q, own in links.items() for x, r in _ranked(own, targets.get(q, []))[0].items()}, abs=1e-9)
    # a query that has converged is in no later step
    assert going == [{q for q in links if steps[q] > k + 1} for k in range(max(steps.values()))]


@pytest.mark.parametrize("few", [0, 100])
def test_a_step_ranks_inner_nodes_alone(spark, monkeypatch, few):
    """Nodes without links in or without links out follow from the others."""
    own = [(f"root{k}", f"in{k % 3}") for k in range(30)] + [("in0", "in1"), ("in1", "in0"), ("in1", "in2"), ("root1", "end9")] + [(f"in{k % 3}", f"end{k}") for k in range(12)]
    targets = {"a": ["root3", "in2", "end4"], "b": []}
    rows, real, ranked = [(q, *e) for q in targets for e in own + own[:5]], neighbourhood.step, []

    def step(df, name):
        out = real(df, name)
        if name == "ranks":
            ranked.append(out.count())
        return out

    monkeypatch.setattr(neighbourhood, "step", step)
    monkeypatch.setattr(neighbourhood, "FEW", few)
    goal = spark.createDataFrame([(q, x) for q, t in targets.items() for x in t], "query string, node_id string")
    found = neighbourhood.personal_ranks(spark.createDataFrame(rows, "query string, subject string, object string"), goal, tolerance=0.0, most=4, hub=2)
    got = {(r.query, r.node_id): r.r for r in found.collect()}
    assert got == pytest.approx({(q, x): r for q, t in targets.items() for x, r in _ranked(own, t, 0.0, 4)[0].items()}, abs=1e-12)
    assert ranked == [6, 6, 6, len(got)]  # three inner nodes a query, and all in the last step


def test_pagerank_without_targets_is_even(spark):
    edges = spark.createDataFrame([("A", "B")], "subject string, object string")
    r = {x.node_id: x.r for x in graphs.pagerank(edges, spark.createDataFrame([], "node_id string"), 12).collect()}
    assert r["B"] > r["A"] > 0 and sum(r.values()) == pytest.approx(1)


def test_neighbourhoods_grow_by_rank(spark):
    rows = [("down", "M:1", "M:2", "subclass_of"), ("rel", "M:1", "M:3", "related_to"), ("pair", "HP:1", "HP:2", "has"), ("mixed", "M:1", "HP:1", "has"), ("keep", "M:1", "C:1", "treats"), ("next", "C:1", "C:9", "treats"), ("far", "C:9", "C:10", "treats")]
    rows += [(f"fan{k:02}", "M:7", f"F:{k:02}", "has") for k in range(30)]
    edges = spark.createDataFrame(rows, "edge_id string, subject string, object string, predicate string")
    starts = spark.createDataFrame([("a", "M:1"), ("b", "M:7"), ("c", "unknown")], "query string, node_id string")
    nodes, found = neighbourhood.neighbourhood(edges, starts, ["subclass_of", "related_to"], "HP:", most=3)
    at = lambda q, hop: [r.node_id for r in nodes.where(f"query = '{q}' and hop = {hop}").orderBy("rank").collect()]
    assert at("a", 1) == ["M:1", "C:1"] and at("a", 2)[0] == "C:1" and set(at("a", 2)) == {"C:1", "M:1", "C:9"}
    assert at("b", 1) == ["M:7", *(f"F:{k:02}" for k in range(14))] and at("c", 1) == []
    assert {r.edge_id for r in found.where("query = 'a'").collect()} == {"mixed", "keep", "next"}
    assert found.where("query = 'b' and hop = 1").count() == 30  # all touch M:7


def test_edges_are_made_once_for_all_steps(spark):
    rows, made = [(f"e{k}", f"M:{k}", f"M:{k + 1}", "has") for k in range(6)], spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    kind = "edge_id string, subject string, object string, predicate string"
    nodes, _ = neighbourhood.neighbourhood(spark.createDataFrame(rows, kind).mapInArrow(count, kind), spark.createDataFrame([("a", "M:1")], "query string, node_id string"), ["none"], "HP:", tolerance=0.0, most=2)
    assert {r.node_id for r in nodes.where("hop = 2").collect()} == {"M:0", "M:1", "M:2", "M:3"}
    assert made.value == len(rows)


def _one_by_one(rows, most):
    left = sorted(set(rows))
    while True:
        n, first = Counter(k for _, k in left), {}
        for i, k in left:
            first.setdefault(k, i)
        top = min(n, key=lambda k: (-n[k], first[k], k), default=None)
        if top is None or n[top] <= most:
            return sorted({i for i, _ in left})
        gone = {i for i, k in left if k == top}
        left = [x for x in left if x[0] not in gone]


@pytest.mark.parametrize(("seed", "hot"), [(0, 1000), (2, 1)])
def test_removal_in_rounds_equals_one_at_a_time(spark, seed, hot, monkeypatch):
    rng = np.random.default_rng(seed)
    rows = [(int(i), f"k{min(int(rng.zipf(1.4)), 40)}") for i in range(150) for _ in range(int(rng.integers(1, 4)))]
    # three groups apart from each other, ties among them
    rows += [(1000 + 100 * g + i, f"g{g}.{i % 2}") for g in range(5) for i in range(30)] + [(1000, "g0.1")]
    rounds, real = [], results.step
    monkeypatch.setattr(results, "step", lambda df, name: rounds.append(name) or real(df, name))
    b = spark.createDataFrame(rows + rows[:20], "result_id long, knode string")
    assert sorted(r.result_id for r in results.without_promiscuous_multi(b, 6, hot=hot).collect()) == _one_by_one(rows, 6)
    assert rounds.count("heavy") <= 8  # at least ten nodes go


@pytest.mark.parametrize(("few", "nodes", "share"), [(0, 0, 0.2), (20, 500_000, 0.05), (10**6, 0, 1.0)])
def test_removal_in_phases_equals_one_at_a_time(spark, few, nodes, share, monkeypatch):
    """a round went over all bindings; now rounds go over contested ones of the most frequent nodes."""
    for name, value in (("FEW", few), ("FEW_NODES", nodes), ("SHARE", share)):
        monkeypatch.setattr(results, name, value)
    rng = np.random.default_rng(11)
    rows = [(int(i), f"k{int(k)}") for i in range(120) for k in rng.integers(0, 14, int(rng.integers(1, 4)))]
    rows += [(1000 + i, f"g.{i % 2}") for i in range(30)] + [(1000, "g.1")]
    sizes, real = [], results.step

    def counted(df, name):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(results, "step", counted)
    b = spark.createDataFrame([*rows, *rows[:20], (None, "k1"), (5000, None)], "result_id long, knode string")
    found = sorted((r.result_id for r in results.without_promiscuous_multi(b, 9, hot=20).collect()), key=str)
    assert found == sorted([*_one_by_one(rows, 9), None, 5000], key=str)
    whole = len(set(rows))
    assert all(n < whole / 2 for name, n in sizes if name == "contested") or share == 1.0
    assert few or [name for name, _ in sizes].count("heavy") > 2


def test_registered_removal_equals_one_at_a_time(spark, sf):
    rows = [(r.result_id, r.sn) for r in star.analyses(spark, sf).collect()]
    assert sorted(r.result_id for r in ranking_queries.q137_promiscuous_rounds(spark, sf).collect()) == _one_by_one(rows, 25)
