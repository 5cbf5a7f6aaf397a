"""Rewriting of query graphs. A query graph is a handful of nodes and edges, so plans are plain values; the work they
describe runs on tables."""

from __future__ import annotations

import json

# The workflows by kind of query.
WORKFLOWS = {"infer": ["lookup", "overlay", "score", "sort_results_score", "filter_results_top_n", "filter_kgraph_orphans"], "lookup": ["lookup", "overlay", "score", "sort_results_score", "filter_results_top_n", "filter_kgraph_orphans"], "pathfinder": ["pathfinder", "score_paths", "sort_results_score", "filter_analyses_top_n", "filter_kgraph_orphans"]}


def examine(query_graph: dict) -> dict:
    """``infer, pathfinder, question, answer``: the pinned and the open node of an inferred query. Raises on mixed queries."""
    edges, paths = query_graph.get("edges") or {}, query_graph.get("paths") or {}
    if len(paths) > 1:
        raise ValueError("only one path is supported")
    if paths and edges:
        raise ValueError("paths and edges don't mix")
    if paths:
        return {"infer": False, "pathfinder": True, "question": None, "answer": None}
    inferred = [e for e in edges.values() if e.get("knowledge_type") == "inferred"]
    if len(inferred) > 1:
        raise ValueError("only one inferred edge is supported")
    if inferred and len(inferred) < len(edges):
        raise ValueError("inferred and lookup edges don't mix")
    if not inferred:
        return {"infer": False, "pathfinder": False, "question": None, "answer": None}
    ends = [inferred[0]["subject"], inferred[0]["object"]]
    pinned = [bool(query_graph["nodes"][n].get("ids")) for n in ends]
    if all(pinned) or not any(pinned):
        raise ValueError("an inferred edge needs one pinned node")
    question = ends[pinned.index(True)]
    return {"infer": True, "pathfinder": False, "question": question, "answer": next(n for n in ends if n != question)}


def workflow(query_graph: dict, given: list | None = None) -> list[str]:
    """A given workflow as it is; else the one of the query's kind."""
    if given:
        return given
    kind = examine(query_graph)
    return WORKFLOWS["pathfinder" if kind["pathfinder"] else "infer" if kind["infer"] else "lookup"]


def canonical(query_graph: dict) -> str:
    """A text that equivalent query graphs share: without defaults and empty constraints, keys in order."""
    # What says nothing, and predicates that mean the same.
    silent = {"is_set": (False, None), "set_interpretation": ("BATCH", None), "constraints": ([], None), "member_ids": ([], None), "ids": (None,), "categories": (None,), "attribute_constraints": ([], None), "qualifier_constraints": ([], None)}
    same = {"biolink:treats": "biolink:treats_or_applied_or_studied_to_treat"}

    def clean(item: dict) -> dict:
        out = {k: v for k, v in item.items() if k != "knowledge_type" and not (k in silent and v in silent[k])}
        if "predicates" in out:
            out["predicates"] = [same.get(p, p) for p in out["predicates"]]
        return out

    return json.dumps({part: {k: clean(v) for k, v in (query_graph.get(part) or {}).items()} for part in ("nodes", "edges")}, sort_keys=True)


def rule_key(edge: dict) -> str:
    """Predicate, aspect and direction of an edge's first constraint, as JSON with sorted keys."""
    out = {"predicate": (edge.get("predicates") or [None])[0]}
    for q in (edge.get("qualifier_constraints") or [{}])[0].get("qualifier_set", []):
        name = q["qualifier_type_id"].rsplit(":", 1)[-1]
        if name in ("object_aspect_qualifier", "object_direction_qualifier"):
            out[name] = q["qualifier_value"]
    return json.dumps(out, sort_keys=True)


def expand(query_graph: dict, rules: dict[str, list[dict]]) -> list[dict]:
    """The direct query, then one for each rule template of its edge, ``$source`` and ``$target`` filled in."""
    (edge,) = query_graph["edges"].values()
    direct = {"nodes": query_graph["nodes"], "edges": {k: {x: y for x, y in e.items() if x != "knowledge_type"} for k, e in query_graph["edges"].items()}}
    out = [direct]
    for template in rules.get(rule_key(edge), []):
        text = json.dumps(template)
        for name, end in (("source", edge["subject"]), ("target", edge["object"])):
            ids = query_graph["nodes"][end].get("ids") or [""]
            text = text.replace(f"${name}_id", ids[0]).replace(f"${name}", end)
        filled = json.loads(text)
        for node in filled["nodes"].values():
            if not [i for i in node.get("ids") or [] if i]:
                node.pop("ids", None)
        out.append(filled)
    return out
