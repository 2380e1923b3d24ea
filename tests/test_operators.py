import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from semloom.operators import cache, cascade, climate, graph, inference, nested, reconcile, skos
from semloom.operators.vocabulary import iri
from semloom.streaming.resample import stream_resample


def test_best_match(spark):
    terms = spark.createDataFrame([(1, "tomato", None, "", None), (2, "zzz", "No Match", "", ""), (3, "x", "u9", "", ""), (4, None, None, None, None)], "term_id long, term string, uri string, rdf_role string, match_type string")
    s = [(1, 10, "p", 1, 1, "u1", "Tomatoe", None, None, None, "FPX", None, None), (1, 11, "p", 1, 2, "u2", "tomato", "d", None, "S", None, None, float("nan")), (2, 12, "p", 1, 1, "u3", "tomato", None, None, None, None, None, 1.0), (3, 13, "p", 1, 1, "u4", "x", None, None, None, None, None, 1.0), (4, 14, "p", 1, 1, "u5", "", None, None, None, None, None, 1.0)]
    sugg = spark.createDataFrame(s, "term_id long, suggestion_id long, provider string, provider_ord int, api_rank int, uri string, label string, description string, ontology_title string, source_provider string, ontology string, db string, score double")
    got = {r["term_id"]: r for r in reconcile.best_match(terms, sugg).collect()}
    assert (got[1]["uri"], got[1]["provider_term"], got[1]["match_type"], got[1]["source_provider"]) == ("u2", "tomato", "skos:exactMatch", "S")
    assert got[2]["uri"] == "No Match" and got[2]["provider_term"] == "" and got[3]["uri"] == "u9" and got[4]["uri"] == "No Match"
    with pytest.raises(ValueError, match="rdf_role"):
        reconcile.prepared(terms.drop("rdf_role"))


INDEX = [("class", "Listeria monocytogenes", "listeria monocytogenes", "i1", 0), ("class", "Salmonella enterica growth", "salmonella enterica growth", "i2", 1), ("individual", "degree celsius", "degree celsius", "i3", 2), ("individual", "degree celsius", "degree celsius", "i4", 3), ("class", "one two three four five", "one two three four five", "i5", 4), ("class", "campylobacter jejuni count", "campylobacter jejuni count", "i6", 5)]


@pytest.mark.parametrize("text,field,iri,number", [("Listeria  Monocytogenes", "hazard", "i1", 1), ("deg c", "unit", "i4", 2), ("monocytogenes listeria sp.", "hazard", "i1", 3), ("one two three four", "hazard", "i5", 4), ("two one four three five x", "hazard", "i5", 5), ("campylobacter jejuni counts", "hazard", "i6", 6), ("listeria monocytogenes", "unit", None, None), ("nothing", "hazard", None, None)])
def test_cascade_passes(spark, text, field, iri, number):
    index = spark.createDataFrame(INDEX, "space string, label string, label_norm string, iri string, ord long")
    syn = spark.createDataFrame([("deg c", "degree celsius", 0)], "syn_norm string, canonical string, ord long")
    q = spark.createDataFrame([(text, field), (text, field), (None, field)], "text string, field string")
    r = cascade.match_ontology(q, index, syn).collect()
    assert len(r) == 1 and (r[0]["iri"], r[0]["pass"]) == (iri, number)


def test_vocabulary_mapper(spark):
    index = spark.createDataFrame(INDEX, "space string, label string, label_norm string, iri string, ord long")
    syn = spark.createDataFrame([("deg c", "degree celsius", 0)], "syn_norm string, canonical string, ord long")
    q = spark.createDataFrame([("c", "unit", t) for t in ("Degree Celsius", "deg c", "celsius", "lysteria monocytogenes", "mine")], "category string, field string, text string")
    own = spark.createDataFrame([("c", "unit", "mine", "own")], "category string, field string, q string, iri string")
    got = {r["text"]: (r["iri"], r["pass"]) for r in cascade.map_vocabulary(q, index, syn, own).collect()}
    assert got == {"Degree Celsius": ("i4", 1), "deg c": ("i4", 2), "celsius": ("i4", 3), "lysteria monocytogenes": ("i1", 4), "mine": ("own", 0)}


def test_graph(spark):
    t = spark.createDataFrame([("a", "p", "b", "iri", None), ("b", "q", "c", "iri", None), ("a", "p", "d", "iri", None), ("a", "p", "b", "iri", None)], graph.SCHEMA)
    assert [tuple(r) for r in graph.path(t.distinct(), "?x", ["p", "q"], "?y").collect()] == [("a", "c")]
    assert graph.merged(t, t).count() == 3
    assert graph.optional(graph.pattern(t.distinct(), "a", "p", "?v"), graph.pattern(t, "?v", "q", "?w")).where("w is null").count() == 1
    gone = graph.removed(t, spark.createDataFrame([("a", "p", None), (None, None, "c")], "s string, p string, o string"))
    assert gone.count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzk"], "node string")
    assert {r["node"]: r["level"] for r in graph.topological_levels(edges, nodes).collect()} == {"a": 0, "k": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    with pytest.raises(ValueError):
        graph.bgp(graph.pattern(t, "?a", "p", "?b"), graph.pattern(t, "?c", "q", "?d"))


def test_skos(spark):
    rows = spark.createDataFrame([(1, "Wheat", "corn, Weizen", "Cereal Crops", ["d"], [" s "]), (2, "Wheat", None, None, [], []), (3, "Weizen2", "Weizen", None, [], []), (4, " ", "x", None, [], [])], "row_id long, term string, alt_label string, concept_group string, definitions array<string>, sources array<string>")
    old = spark.createDataFrame([("http://o/w", iri("rdf:type"), iri("skos:Concept")), ("http://o/w", iri("skos:altLabel"), "Weizen")], "s string, p string, o string")
    got = {(r["s"], r["p"], r["o"]) for r in skos.upsert(rows, old.limit(0), "http://b/").collect()}
    assert ("http://b/concept/cereal-crops/wheat", iri("skos:altLabel"), "corn") in got and ("http://b/scheme/cereal-crops", iri("rdf:type"), iri("skos:ConceptScheme")) in got and ("http://b/concept/weizen2", iri("skos:prefLabel"), "Weizen2") in got
    assert {r["s"] for r in skos.upsert(rows, old, "http://b/").where(F.col("p") == iri("skos:altLabel")).collect()} == {"http://o/w"}
    m = spark.createDataFrame([("c", "SKOS:exactmatch ", "http://n/2"), ("c", "skos:exactMatch", "http://m/1"), ("c", "odd", "http://n/3"), ("c", None, "http://n/4")], "s string, match_type string, uri string")
    e = spark.createDataFrame([("c", iri("skos:exactMatch"), "http://n/1")], "s string, p string, o string")
    assert [tuple(r) for r in skos.conflicts(m, e).collect()] == [("c", iri("skos:exactMatch"), "http://n/1", "http://n/2")]
    lines = spark.createDataFrame([("@prefix obo: <http://purl.example/obo/> .",), ("PREFIX mondo: <http://purl.example/obo/>",), ("nothing",)], "value string")
    p = skos.read_prefixes(lines)
    uris = spark.createDataFrame([("http://purl.example/obo/MONDO_1",), ("http://purl.example/obo/MONDO_2",), ("http://other/x",)], "uri string")
    assert [(r["prefix"], r["namespace"]) for r in skos.assign_prefixes(uris, p).collect()] == [("mondo", "http://purl.example/obo/")]


def test_climate(spark):
    nan = float("nan")
    g = spark.createDataFrame([(datetime(2024, 1, 1, 12), 0.0, 1.0, 280.0), (datetime(2024, 1, 1, 12), 60.0, 1.0, 290.0), (datetime(2024, 1, 3, 12), 0.0, 1.0, nan), (None, 0.0, 1.0, 1.0)], "time timestamp, y double, x double, tas double")
    days = {str(r["bucket"]): (r["mean"], r["n"]) for r in climate.resample(g, "time", "tas", "D", fill=True).collect()}
    assert days == {"2024-01-01": (285.0, 2), "2024-01-02": (None, 0), "2024-01-03": (None, 0)}
    assert str(climate.resample(g, "time", "tas", "W").first()["bucket"]) == "2024-01-07"
    one = g.where("time < '2024-01-02'").agg(climate.weighted_mean(F.col("tas"), F.col("y")).alias("w")).first()["w"]
    assert one == pytest.approx((280 + 290 * 0.5) / 1.5)
    assert climate.to_celsius(g.where("time is not null"), "tas").where("abs(tas - 6.85) < 1e-9").count() == 1 and climate.to_celsius(g.limit(0), "tas", "K").count() == 0
    lat, lon = climate.from_rotated(F.lit(0.0), F.lit(0.0), 39.25, -162.0)
    r = spark.range(1).select(lat.alias("a"), lon.alias("o")).first()
    assert r["a"] == pytest.approx(50.75) and r["o"] == pytest.approx(18.0)
    regions = spark.createDataFrame([("r", "POLYGON ((-1 -1, 3 -1, 3 3, -1 3, -1 -1), (1.5 1.5, 2 1.5, 2 2, 1.5 2, 1.5 1.5))"), ("none", None)], "region string, wkt string")
    cells = spark.createDataFrame([(0.5, 0.5), (1.7, 1.7), (5.0, 5.0)], "x double, y double")
    assert [(r["x"], r["region"]) for r in climate.clip(cells, regions).collect()] == [(0.5, "r")]
    assert math.isclose(spark.range(1).select(climate.sane(climate.pad(climate.bbox(F.lit("POINT (179 89)")), 2.0))["n"].alias("n")).first()["n"], 90)


def test_nested(spark):
    doc = '{"generalInformation": {"identifier": "M 1", "creator": [{"email": "a"}, {"email": "b"}]}, "modelMath": {"parameter": [{"id": "p/1", "unit": "kg"}]}, "x": null, "n": [1, [2]]}'
    docs = spark.createDataFrame([("m", doc), ("bad", "{"), ("none", None), ("deep", "[" * 300 + "]" * 300)], "model_id string, doc string")
    n = nested.walk(docs, "model_id", "doc").cache()
    assert n.where("model_id = 'bad' or model_id = 'none'").count() == 0 and n.where("model_id = 'deep'").count() == 300
    ids = {r["iri"] for r in nested.identified(n.where("model_id = 'm'"), "http://b/").collect()}
    assert "http://b/m/parameter/p_1" in ids and "http://b/m/generalInformation" in ids and sum("/creator/" in i for i in ids) == 2
    mapped = nested.mapped_values(n, spark.createDataFrame([("unit", "kg", "u:kg")], "field string, text string, iri string"))
    assert mapped.where("iri = 'u:kg'").count() == 1
    assert {r["name"]: r["valid"] for r in nested.validity(docs, "model_id", "doc").collect()} == {"m": True, "bad": False, "none": False, "deep": True}
    links = nested.parameter_links(spark.createDataFrame([("t", "p1", "s", "q")], "target_alias string, target_param string, source_alias string, source_param string"), spark.createDataFrame([("t", "A"), ("s", "B")], "alias string, model_id string"), spark.createDataFrame([("A", "p", "iA"), ("B", "q2", "iB")], "model_id string, param_id string, iri string"))
    assert [tuple(r) for r in links.collect()] == [("iA", "iB")]


def test_inference(spark):
    c = spark.createDataFrame([("Kilogram", 0, "kilogram", "kg, kilo"), ("Dimensionless", 1, "dimensionless", None), ("Growth time", 2, "growth time", "duration")], "display string, ord int, term string, alts string")
    got = {r["text"]: r["display"] for r in inference.match_units(spark.createDataFrame([("KG",), ("kilogrm",), ("[]",), ("zzz",), (None,)], "text string"), c).collect()}
    assert got == {"KG": "Kilogram", "kilogrm": "Kilogram", "[]": "Dimensionless"}
    kw = {r["text"]: r["display"] for r in inference.match_keywords(spark.createDataFrame([("time_of_growth",), ("x",)], "text string"), c).collect()}
    assert kw == {"time_of_growth": "Growth time"}


def test_cache(spark):
    now = datetime(2024, 1, 10)
    c = spark.createDataFrame([("a", "1", datetime(2024, 1, 9)), ("b", "2", datetime(2023, 1, 1)), ("c", "3", None)], "k string, value string, cached_at timestamp")
    assert tuple(cache.stats(c, now).first()) == (3, 1, 2)
    assert {r["k"]: r["value"] for r in cache.lookup(spark.createDataFrame([("a",), ("b",)], "k string"), c, "k", now).collect()} == {"a": "1", "b": None}
    new = cache.put(c, spark.createDataFrame([("b", "9", now)], c.schema), "k")
    assert new.count() == 3 and new.where("value = '9'").count() == 1 and cache.removed(new, new.where("k = 'a'"), "k").count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(datetime(2024, 1, d, 12), float(d)) for d in range(1, 6)] + [(datetime(2024, 1, 1, 13), float("nan"))], "ts timestamp, v double")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    q = stream_resample(stream, "ts", "v").writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["bucket"])[:10]: (r["mean"], r["n"]) for r in spark.sql("select * from means").collect()}
    assert got.get("2024-01-01") == (1.0, 1) and "2024-01-05" not in got
