import glob
import json

from semloom.operators import graph, inference
from semloom.operators.vocabulary import Vocabulary, iri
from semloom.sources.sinks import write_jsonld

B = "http://l/"
V = Vocabulary.of("http://m/")


def test_mappings_are_replaced(spark):
    old = spark.createDataFrame(
        [("m", V.hazard, "h0", "iri", None), ("m", V.product, "p0", "iri", None), ("m", B + "hasOutputMapping", "old", "bnode", None), ("old", iri("rdf:type"), B + "OutputMapping", "iri", None), ("m", B + "hasInputMapping", "old2", "bnode", None),
         ("old2", B + "mapsParameter", "in", "iri", None), ("in", iri("skos:exactMatch"), "u0", "iri", None), ("in", B + "preferredInputUnit", "k0", "iri", None), ("out", iri("skos:exactMatch"), "u0", "iri", None), ("in", iri("schema:name"), "x", "literal", None),
         ("n", V.hazard, "h0", "iri", None), ("n", B + "hasOutputMapping", "keep", "bnode", None), ("keep", iri("rdf:type"), B + "OutputMapping", "iri", None)], graph.SCHEMA)
    shape = "model string, parameter string, uris array<string>, unit string"
    added = inference.parameter_mappings(spark.createDataFrame([("m", "in", ["u1", "nan", None, " u2 "], "k1")], shape), spark.createDataFrame([("m", "out", ["u3", "u4"], "k2"), ("m", "none", [], "")], shape), B)
    wired = inference.input_mappings(spark.createDataFrame([("m", "in", "ds", "v")], "model string, parameter string, source string, variable string"), B)
    added = added.unionByName(wired)
    parameters = spark.createDataFrame([("m", "in", "i"), ("m", "out", "o"), ("m", "none", "o")], "model string, parameter string, side string")
    scope = spark.createDataFrame([("m", "hazard", "h1"), ("m", "hazard", "h2")], "model string, kind string, uri string")
    new = inference.applied(old, parameters, scope, added, B, V)
    got = {(r["s"], r["p"], r["o"]) for r in new.collect()}
    (out,) = [o for s, p, o in got if s == "m" and p == B + "hasOutputMapping"]
    (into,) = [o for s, p, o in got if s == "m" and p == B + "hasInputMapping"]
    assert got == {
        ("m", V.hazard, "h1"), ("m", V.hazard, "h2"), ("m", B + "hasOutputMapping", out), (out, iri("rdf:type"), B + "OutputMapping"), (out, B + "mapsParameter", "out"), (out, B + "producesObservedProperty", "u3"),
        (out, B + "hasOutputUnit", "k2"), ("out", iri("skos:exactMatch"), "u3"), ("out", iri("skos:exactMatch"), "u4"), ("in", iri("skos:exactMatch"), "u1"), ("in", iri("skos:exactMatch"), "u2"), ("in", B + "preferredInputUnit", "k1"), ("in", iri("schema:name"), "x"),
        ("m", B + "hasInputMapping", into), (into, iri("rdf:type"), B + "InputMapping"), (into, B + "mapsParameter", "in"), (into, B + "isFulfilledBy", "ds"), (into, B + "sourceVariableName", "v"),
        ("n", V.hazard, "h0"), ("n", B + "hasOutputMapping", "keep"), ("keep", iri("rdf:type"), B + "OutputMapping"),
    }
    assert {(r["s"], r["p"], r["o"]) for r in inference.applied(new, parameters, scope, added, B, V).collect()} == got


def test_jsonld(spark, tmp_path):
    t = spark.createDataFrame([("http://a", iri("rdf:type"), "skos:Concept", "iri", None), ("http://a", "skos:prefLabel", 'é "q"\n', "literal", "en"), ("http://a", "skos:altLabel", "x", "literal", None), ("http://a", "ex:n", "b1", "bnode", None), ("b1", "ex:p", "http://c", "iri", None)], graph.SCHEMA)
    write_jsonld(t, str(tmp_path / "o"), {"skos": "http://s#"})
    nodes = {}
    for f in glob.glob(str(tmp_path / "o/part-*")):
        if text := open(f, encoding="utf-8").read():
            doc = json.loads(text)
            assert doc["@context"] == {"skos": "http://s#"}
            nodes |= {n["@id"]: n for n in doc["@graph"]}
    assert nodes == {
        "http://a": {"@id": "http://a", "@type": ["skos:Concept"], "skos:prefLabel": [{"@value": 'é "q"\n', "@language": "en"}], "skos:altLabel": [{"@value": "x"}], "ex:n": [{"@id": "_:b1"}]},
        "_:b1": {"@id": "_:b1", "ex:p": [{"@id": "http://c"}]},
    }
