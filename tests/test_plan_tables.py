"""Hierarchies, lookups by parents and qualifiers, and templates, against brute force over small tables."""

import json
import random
from itertools import product

from kgloom.plans import descendants, templates

QUERIES = "query_id string, predicates array<string>, subject_categories array<string>, object_categories array<string>, qualifiers map<string,string>, subject_id string, object_id string"
EDGES = "edge_id string, subject string, object string, predicate string, qualifiers map<string,string>, query_id string, above string"


def _reach(parents):
    below = {x: {x} for p in parents for x in p if None not in p}
    changed = True
    while changed:
        changed = False
        for child, parent in parents:
            if child and parent and not below[child] <= below[parent]:
                below[parent] |= below[child]
                changed = True
    return below


def test_closure_of_random_hierarchies_with_cycles(spark):
    rng = random.Random(5)
    for n, m in ((3, 3), (9, 9), (14, 20)):
        parents = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(None, "n0"), ("n0", None)]
        found = [tuple(r) for r in descendants.closure(spark.createDataFrame(parents + parents[:2], "child string, parent string")).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a, all_ in _reach(parents).items() for b in all_}
    chain = [(f"biolink:c{k}", f"c{k + 1}") for k in range(40)]
    assert descendants.closure(spark.createDataFrame(chain, "child string, parent string")).count() == 41 * 42 // 2
    assert descendants.closure(spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([("x",), (None,)], "name string")).collect() == [("x", "x")]


def test_lookup_by_parents_equals_brute_force(spark):
    rng = random.Random(11)
    parents = [("a", "ab"), ("b", "ab"), ("ab", "top"), ("c", "top"), ("p1", "p"), ("p2", "p"), ("q1", "lo"), ("q2", "lo"), ("lo", "any")]
    below = _reach(parents)
    pick = lambda xs, k: [rng.choice(xs) for _ in range(rng.randrange(k + 1))]
    quals = lambda vs: rng.choice([None, {}, {"k": rng.choice(vs)}, {"k": rng.choice(vs), "l": rng.choice(vs)}])
    cats = [(f"n{k}", rng.choice(["a", "b", "biolink:c", "z", None])) for k in range(8) for _ in range(2)]
    edges = [(f"e{k}", rng.choice([None, *(f"n{i}" for i in range(8))]) if k < 5 else f"n{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.choice(["p1", "p2", "biolink:p", "other"]), quals(["q1", "q2", "lo", "new"]), "clash", "clash") for k in range(400)]
    queries = [(f"q{k}", rng.choice([["p"], ["biolink:p1", "other"], ["other"], [], None]), rng.choice([None, pick(["ab", "top", "z", "biolink:a"], 2)]), rng.choice([None, pick(["ab", "c"], 2)]), quals(["lo", "any", "q1", "new"]), rng.choice([None, "n1", "n2"]), rng.choice([None, "n3", "n4"])) for k in range(60)]
    bare = lambda x: x.removeprefix("biolink:")
    under = lambda names, x: any(bare(x) in below.get(bare(n), {bare(n)}) for n in names)

    def fits(q, e):
        ends = all(not want or any(c and under(want, c) for n, c in cats if n == node) for want, node in ((q[2], e[1]), (q[3], e[2])))
        held = all(k in (e[4] or {}) and under([v], e[4][k]) for k, v in (q[4] or {}).items())
        return e[1] and e[2] and under(q[1] or [], e[3]) and ends and held and q[5] in (None, e[1]) and q[6] in (None, e[2])

    pairs = descendants.closure(spark.createDataFrame(parents, "child string, parent string"))
    q, e, c = spark.createDataFrame(queries + queries[:9], QUERIES), spark.createDataFrame(edges + edges[:9], EDGES), spark.createDataFrame(cats, "node_id string, category string")
    found = [tuple(r) for r in descendants.looked_up(q, e, c, pairs).collect()]
    assert sorted(found) == sorted((a[0], b[0]) for a, b in product(queries, edges) if fits(a, b))
    assert len(found) > 50
    assert descendants.looked_up(q.limit(0), e, c, pairs).count() == descendants.looked_up(q, e.limit(0), c, pairs).count() == 0
    # a parent category answers what its descendants answer together
    ask = lambda name, want: descendants.looked_up(spark.createDataFrame([(name, ["p", "other"], want, None, None, None, None)], QUERIES), e, c, pairs).select("edge_id").collect()
    assert set(ask("x", ["top"])) == set(ask("x", ["a"])) | set(ask("x", ["b"])) | set(ask("x", ["c"]))


ASKS = "query_id string, subject_key string, object_key string, subject_types array<string>, object_types array<string>, predicates array<string>, qualifiers map<string,string>, subject_id string, object_id string"
GROUPS = "name string, subject array<string>, object array<string>, predicate array<string>, qualifiers map<string,string>, templates array<string>"


def test_groups_fit_as_by_brute_force(spark):
    rng = random.Random(3)
    some = lambda xs: rng.choice([None, *([rng.choice(xs) for _ in range(rng.randrange(4))] for _ in range(9))])
    quals = lambda: rng.choice([None, {}, {"a": "1"}, {"a": "2", "b": "1"}, {"b": "1"}])
    asks = [(f"q{k}", "s", "o", some(["A", "biolink:A", "B"]), some(["C", "D"]), some(["p", "biolink:q"]), quals(), "X:1", None) for k in range(150)]
    groups = [(f"g{k}", some(["A", "B"]), some(["C", "D", "biolink:E"]), some(["p", "q"]), quals(), ["t"]) for k in range(40)]
    names = lambda xs: {x.removeprefix("biolink:") for x in xs or []}
    want = {(a[0], g[0]) for a, g in product(asks, groups) if all(names(a[3 + k]) & names(g[1 + k]) for k in range(3)) and (a[6] or {}).items() <= (g[4] or {}).items()}
    q, g = spark.createDataFrame(asks + asks[:5], ASKS), spark.createDataFrame(groups, GROUPS)
    found = [tuple(r) for r in templates.matched(q, g).select("query_id", "name").collect()]
    assert len(found) == len(want) > 10 and set(found) == want
    assert templates.matched(q, g.limit(0)).count() == templates.matched(q.limit(0), g).count() == 0


def test_templates_are_read_and_filled_in(spark, tmp_path):
    body = {"nodes": {"$source": {"ids": ["$source_id"], "categories": ["A"]}, "$target": {"ids": ["$target_id"]}}, "edges": {"e": {"subject": "$source", "object": "$target", "predicates": ["p"]}}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "sub" / "two.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{'a'")
    (tmp_path / "note.txt").write_text("{}")
    corpus = templates.read_corpus(spark, str(tmp_path))
    assert {(r.template, r.valid) for r in corpus.collect()} == {("one", True), ("two", True), ("bad", False)}
    groups = spark.createDataFrame([("g", ["A"], ["B"], ["p"], None, ["two", "one"]), ("h", ["A"], ["B"], ["p"], {"a": "1"}, ["one"])], GROUPS)
    asks = [("q1", 'k"1\\', "$source", ["A"], ["B"], ["p"], None, "X:$target_id", None), ("q2", "s", "o", ["A"], ["B"], ["p"], None, None, "Y:2"), ("q3", "s", "o", ["none"], ["B"], ["p"], None, "X:1", None)]
    rows = templates.filled(spark.createDataFrame(asks + asks[:1], ASKS), groups, corpus.where("valid"))
    assert sorted((r.query_id, r.n, r.template) for r in rows.collect()) == [("q1", 0, None), ("q1", 1, "one"), ("q1", 2, "two"), ("q2", 0, None), ("q2", 1, "one"), ("q2", 2, "two"), ("q3", 0, None)]
    nodes = {(r.query_id, r.n, r.node): r.ids for r in templates.graph_nodes(rows).collect()}
    assert nodes == {("q1", n, k): v for n in (1, 2) for k, v in (('k"1\\', ["X:$target_id"]), ("$source", None))} | {("q2", n, k): v for n in (1, 2) for k, v in (("s", None), ("o", ["Y:2"]))}
    assert {(r.subject, r.object, tuple(r.predicates)) for r in templates.graph_edges(rows).collect()} == {('k"1\\', "$source", ("p",)), ("s", "o", ("p",))}


def test_a_lookup_stores_answers_not_all_edges_met(spark, monkeypatch):
    from kgloom.plans import descendants as d

    sizes, step = [], d.step

    def counted(df, name):
        out = step(df, name)
        if name == "met":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(d, "step", counted)
    schema = "query_id string, predicates array<string>, subject_categories array<string>, object_categories array<string>, qualifiers map<string,string>, subject_id string, object_id string"
    queries = spark.createDataFrame([("q", ["related"], None, ["thing"], {"aspect": "odd"}, "A", None), ("r", ["treats"], ["thing"], None, None, None, "n4"), ("s", ["treats"], ["place"], None, None, None, "n4"), ("t", ["treats"], None, None, {"aspect": None}, "A", None)], schema)
    edges = spark.createDataFrame([(f"e{i}", "A", f"n{i}", "treats", {"aspect": "one" if i == 4 else "two"}) for i in range(30)], "edge_id string, subject string, object string, predicate string, qualifiers map<string,string>")
    categories = spark.createDataFrame([("A", "drug"), ("n4", "drug"), ("n5", "drug")], "node_id string, category string")
    family = spark.createDataFrame([("drug", "thing"), ("treats", "related"), ("one", "odd")], "child string, parent string")
    found = {tuple(r) for r in d.looked_up(queries, edges, categories, d.closure(family)).collect()}
    assert found == {("q", "e4"), ("r", "e4")} and sizes and max(sizes) <= 2


def test_filled_graphs_are_read_without_a_shuffle(spark):
    from kgloom.plans import templates as t

    graph = '{"nodes": {"b": {"ids": [""], "categories": ["B", "C"]}, "a": {"ids": ["", "X:1"], "categories": []}}, "edges": {"e": {"subject": "a", "object": "b", "predicates": ["p"]}}}'
    rows = spark.createDataFrame([("q", 0, None, None), ("q", 1, "t", graph)], "query_id string, n int, template string, graph string")
    out = t.graph_texts(rows)
    assert sorted(map(tuple, out.collect())) == [("q", 0, None, None, None), ("q", 1, "t", "a=X:1::;b=::B,C", "e=a-p-b")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
