"""Graph operators over what the readers load, and what the sinks write read back."""

import pytest
from pyspark.sql import functions as F

from semloom.operators import graph as G
from semloom.operators import skos
from semloom.operators.vocabulary import Vocabulary, iri
from semloom.sources import rdf, sinks

M = "http://m.example/"
V = Vocabulary.of(M)
TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix schema: <https://schema.org/> .
@prefix geo: <http://www.opengis.net/ont/geosparql#> .
@prefix m: <http://m.example/> .
@prefix x: <http://x.example/> .
x:wheat a skos:Concept ; skos:prefLabel "Wheat"@en ; skos:altLabel "corn", "Weizen"@de ; skos:inScheme <http://x.example/scheme/crop> .
x:mould a skos:Concept ; skos:prefLabel "Mould"@en ; skos:exactMatch <http://y.example/7> .
x:one a m:Model ; schema:identifier "M1" ; schema:name "toxin" ; m:hasScope x:scope ; m:hasParameter x:p1, x:p2 .
x:scope m:product x:wheat ; m:hazard x:mould .
x:two a m:Model ; schema:identifier "M2" ; schema:name "toxin growth" ; m:product x:wheat ; m:hazard x:mould ; m:hasParameter x:p3 .
x:p1 schema:name "dose" ; m:classification "OUTPUT" ; m:unit "mg" .
x:p2 schema:name "time9" ; m:classification "INPUT" .
x:p3 schema:name "Dose" ; m:classification "http://c.example/C_17481" , "input" .
x:r a skos:Concept ; skos:prefLabel "North" ; m:level "2" ; geo:hasGeometry [ geo:asWKT "POINT (1 2)" ] .
"""


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("g")
    (d / "a.ttl").write_text(TTL)
    return rdf.read_rdf(spark, str(d)).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


X = "http://x.example/"


def test_queries_on_a_turtle_folder(spark, t):
    ask = lambda *x: spark.createDataFrame([(v,) for v in x], "term string")
    labels = [V.pref_label, V.alt_label]
    assert rows(G.search_labels(t, ask("WHE", "o", "zz", " "), [V.concept], labels, {"scheme": V.in_scheme}, 2)) == [("WHE", X + "wheat", "Wheat", X + "scheme/crop", 1), ("o", X + "mould", "Mould", None, 1), ("o", X + "r", "North", None, 2)]
    assert rows(G.search_labels(t, ask("weiz", "whe"), [V.concept], labels, {}, 2, lang="en").select("term")) == [("whe",)]
    assert rows(G.concepts_in_schemes(t, [X + "scheme/"])) == [(X + "wheat", X + "scheme/crop", "Wheat")]
    assert rows(G.catalogue(t, V)) == [(X + "wheat", "Wheat", X + "mould", "Mould")]
    assert rows(G.find_models(t, V)) == [(X + "wheat", X + "mould", X + "one")]
    assert rows(G.regions(t, ["2", "3"], V)) == [(X + "r", "2", "North", "POINT (1 2)")] and rows(G.region_shape(t, X + "r")) == [("POINT (1 2)",)] and G.regions(t, ["9"], V).count() == 0
    assert rows(G.parameters(t, {"17481": "INPUT"}, V)) == [(X + "one", "dose", "dose", "mg", ["OUTPUT"]), (X + "two", "Dose", "Dose", None, ["INPUT"])]
    assert rows(G.connections(t, V)) == [(X + "one", X + "two", "dose")]
    assert rows(G.match_by_uri(t, spark.createDataFrame([("http://y.example/7",), (X + "wheat",), ("none",)], "uri string"))) == [(X + "wheat", X + "wheat"), ("http://y.example/7", X + "mould")]
    assert rows(G.match_by_label(t, spark.createDataFrame([("CORN",), ("x",), (None,)], "text string"))) == [("CORN", X + "wheat")]
    assert (X + "wheat", "Wheat (Weizen; corn)") in rows(G.display_structs(t))
    assert rows(G.main_model(t, V)) == [(X + "one",)] and rows(G.direct_scope(t, V)) == [("hazard", X + "mould"), ("product", X + "wheat")]
    assert rows(G.scope_candidates(t, V)) == [("hazard", X + "mould", None, [X + "mould"]), ("product", X + "wheat", None, [X + "wheat"])]
    uris = spark.createDataFrame([("http://y.example/7",)], "uri string")
    assert rows(G.variable_candidates(t, uris, V)) == [("http://y.example/7", X + "mould", "mould", "Mould", "", "mould")]
    models = G.bgp(G.pattern(t, "?model", V.type, V.model), G.pattern(t, "?model", V.name, "?name"))
    assert rows(G.without_containers(models).select("name")) == [("toxin",)]


def test_upsert_on_a_turtle_folder(spark, t, tmp_path):
    wide = spark.createDataFrame(
        [(1, "Wheat", "durum", None, ["d"], [], [("exactMatch", "http://z/1"), ("skos:exactMatch", " http://z/a/1 "), ("skos:exactMatch", "http://z/a/2")]), (2, "Rye", None, "Crop", [], [], [])],
        "row_id long, term string, alt_label string, concept_group string, definitions array<string>, sources array<string>, mappings array<struct<match_type:string,uri:string>>",
    )
    new = skos.upsert(wide, t, "http://b.example/")
    got = {(r["s"], r["p"], r["o"]) for r in new.collect()}
    # Of two new uris of one namespace the first stands; a match type without its prefix is unknown.
    assert {o for s, p, o in got if p == iri("skos:exactMatch")} == {"http://z/a/1"}
    assert (X + "wheat", V.alt_label, "durum") in got and ("http://b.example/concept/crop/rye", V.type, V.concept) in got and ("http://b.example/scheme/crop", V.title, "Crop Vocabulary") in got
    sinks.write_ntriples(new, str(tmp_path / "n"))
    assert {(r["s"], r["p"], r["o"]) for r in rdf.read_ntriples(spark, str(tmp_path / "n")).collect()} == got
    sinks.write_trig(new.withColumn("g", F.when(F.col("is_new"), "http://g.example/new")), str(tmp_path / "t"), {})
    back = [r for f in (tmp_path / "t").glob("part*") if f.read_text() for r in rdf.parse(f.read_text(), "f.trig")]
    assert {r[1:4] for r in back} == got and {r[0] for r in back} == {"http://g.example/new", "f.trig"}


def test_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# c\n\n<http://a/1> <http://a/p> "C:\\\\new \\u00e9\\U0001F600 \\"q\\"\\n"@en <http://g/1> .\n<http://a/1> <http://a/p> broken\n')
    kept = rdf.read_ntriples(spark, str(tmp_path / "a.nt"), bad="keep").collect()
    assert [(r["o"], r["o_lang"], r["g"]) for r in kept if r["bad"] is None] == [('C:\\new é😀 "q"\n', "en", "http://g/1")] and sum(r["bad"] is not None for r in kept) == 1
    with pytest.raises(Exception, match="no triple"):
        rdf.read_ntriples(spark, str(tmp_path / "a.nt")).collect()
    t = spark.createDataFrame([("http://a", "rdf:type", "skos:Concept", "iri", None)], G.SCHEMA)
    assert sinks.ntriples(t).first()[0] == f"<http://a> <{iri('rdf:type')}> <{iri('skos:Concept')}> ."
    with pytest.raises(Exception, match="no iri"):
        sinks.ntriples(t.withColumn("p", F.lit("plain"))).collect()


def test_open_patterns(spark, t):
    pat = lambda *x: spark.createDataFrame([*x], "s string, p string, o string")
    n = t.count()
    assert G.removed(t, pat((None, V.alt_label, None))).count() == n - 2 and G.removed(t, pat((None, None, "corn"), (X + "r", None, None))).count() == n - 1 - t.where(F.col("s") == X + "r").count()
    assert G.removed(t, pat((None, None, None))).count() == 0 and G.removed(t, pat()).count() == n


def test_short_namespace(spark):
    listed = spark.createDataFrame([("http://x.y/", "xy", 0), ("urn:a:", "ua", 1)], "namespace string, prefix string, ord long")
    uris = spark.createDataFrame([("http://x.y/1",), ("urn:a:b",), ("",), (None,)], "uri string")
    assert rows(skos.assign_prefixes(uris, listed).select("prefix", "namespace")) == [("ua", "urn:a:"), ("xy", "http://x.y/")]


def test_workbook(spark, tmp_path):
    from semloom.sources.files import Workbook

    spark.dataSource.register(Workbook)
    df = spark.createDataFrame([(1, "a<b>&", None), (2, " ü\n", "x")], "i int, t string, u string").coalesce(1)
    assert rows(sinks.write_workbooks(df, str(tmp_path / "w"), rows=1).select("n")) == [(1,), (1,)]
    assert rows(spark.read.format("workbook").load(str(tmp_path / "w")).fillna("")) == [("1", "a<b>&", ""), ("2", " ü\n", "x")]
