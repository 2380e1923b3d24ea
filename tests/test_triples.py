import hashlib
import json
import re

from semloom.operators import nested
from semloom.plans import registry


def brute(model, doc, context, vocab, ids):
    """Triples of one document by recursion; a list within a list says nothing."""
    out, count = set(), iter(range(10**6))

    def name(node):
        return ids.get((model, node)) or "_:b" + hashlib.md5(f"{model}|{node}".encode()).hexdigest()[:16]

    def iri(path, key):
        scopes = [".".join(path[:i]) for i in range(len(path) + 1)]
        return next((context[s, key] for s in reversed(scopes) if (s, key) in context), key if key.startswith("@") else vocab + key)

    def go(value, path, key, owner, lists):
        node = next(count)
        kind = "bnode" if name(node).startswith("_:") else "iri"
        if isinstance(value, dict):
            if owner is not None and lists < 2:
                out.add((name(owner), iri(path, key), name(node), kind))
            for k, v in value.items():
                go(v, [*path, key] if key else path, k, node, 0)
        elif isinstance(value, list):
            for v in value:
                go(v, path, key, owner, lists + 1)
        elif value is not None and owner is not None and lists < 2:
            out.add((name(owner), iri(path, key), value if isinstance(value, str) else json.dumps(value), "literal"))

    go(doc, [], "", None, 0)
    return out


def test_triples_by_brute_force(spark):
    docs = {
        "m 1": {"@type": "M", "name": "top", "a": {"name": "in", "b": {"name": "deep", "id": 1, "n": None, "ok": True}}, "ab": {"name": "not in a"}, "l": [1, [2, {"x": 3}], {"id": "p", "name": "q"}, {"id": "p", "name": "q"}], "e": {}},
        "m2": [{"name": "x"}, "y", [{"name": "z"}]],
        "m3": "text",
    }
    context = {("", "name"): "s:name", ("a", "name"): "a:name", ("a.b", "id"): "ab:id", ("l", "id"): "l:id"}
    nodes = nested.walk(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "model_id string, doc string"), "model_id", "doc")
    ids = nested.identified(nodes, "http://b/")
    known = {(r["model_id"], r["node_id"]): r["iri"] for r in ids.collect()}
    got = nested.to_triples(nested.with_context(nodes, spark.createDataFrame([(*k, v) for k, v in context.items()], "scope string, key string, iri string"), "v:"), ids).collect()
    assert known and len({tuple(r) for r in got}) == len(got)
    assert {tuple(r) for r in got} == set().union(*(brute(m, d, context, "v:", known) for m, d in docs.items()))


def test_long_contexts_and_ids_of_two_kinds(spark, monkeypatch):
    nodes = nested.walk(spark.createDataFrame([("m", '{"a": {"name": "x", "id": "y"}}')], "model_id string, doc string"), "model_id", "doc")
    context = spark.createDataFrame([("", "name", "s:name"), ("a", "name", "a:name"), (None, "id", "none"), ("", "a", "s:a")], "scope string, key string, iri string")
    monkeypatch.setattr(nested, "BROADCAST_CONTEXT", 1)
    got = nested.to_triples(nested.with_context(nodes, context, "v:"), spark.createDataFrame([("m", 1, "i:1"), ("m", 1, "i:2")], "model_id string, node_id long, iri string"))
    root = "_:b" + hashlib.md5(b"m|0").hexdigest()[:16]
    assert {tuple(r) for r in got.collect()} == {(root, "s:a", i, "iri") for i in ("i:1", "i:2")} | {(i, p, o, "literal") for i in ("i:1", "i:2") for p, o in (("a:name", "x"), ("v:id", "y"))}


def test_nothing_of_the_documents_is_broadcast(spark, data):
    """j2_triples failed by the driver's memory: its tables of nodes were joined with each other by broadcasts, each with a walk of its own."""
    df = registry.QUERIES["j2_triples"](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sides = [line for line in re.findall(r"(?:Broadcast|SortMerge)\w*Join \[.*", plan) if "node_id" in line or "owner_id" in line or "parent_id" in line]
    assert sides and all(line.startswith("SortMerge") for line in sides)
    assert plan.count("MapInPandas") <= 4
