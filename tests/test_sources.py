import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from semloom.operators.vocabulary import iri
from semloom.sources import files, providers, rdf, sinks

TTL = """@prefix ex: <http://x/> . # a comment
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
ex:a a skos:Concept ; skos:prefLabel "A \\"q\\""@en, "B"@en-GB ; ex:n 4, 2.5, true ;
  ex:v "7.5"^^xsd:decimal ; ex:long \"\"\"two
lines\"\"\" ; ex:node [ ex:p ex:b ; ex:q "x" ] ; ex:list ( ex:one "two" ) .
_:k ex:p <http://y/z#f> .
"""


def test_turtle():
    t = rdf.Turtle(TTL, "f").parse()
    assert ("http://x/a", rdf.RDF + "type", "http://www.w3.org/2004/02/skos/core#Concept", "iri", None, None) in t
    assert ("http://x/a", "http://www.w3.org/2004/02/skos/core#prefLabel", 'A "q"', "literal", "en", None) in t
    assert ("http://x/a", "http://x/long", "two\nlines", "literal", None, None) in t
    assert ("http://x/a", "http://x/v", "7.5", "literal", None, rdf.XSD + "decimal") in t
    assert {x[2] for x in t if x[1] == "http://x/n"} == {"4", "2.5", "true"}
    assert sum(x[1] == rdf.RDF + "first" for x in t) == 2 and len(t) == 17
    with pytest.raises(ValueError):
        rdf.Turtle("ex:a ex:b ex:c .").parse()


def test_files_and_round_trip(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.ttl").write_text(TTL.split("_:k")[0])
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/"><e:T rdf:about="http://x/r"><e:p xml:lang="de">t</e:p><e:q rdf:resource="http://x/a"/></e:T></rdf:RDF>')
    (tmp_path / "d.jsonld").write_text(json.dumps({"@context": {"ex": "http://x/", "name": "ex:name"}, "@id": "ex:j", "@type": "ex:T", "name": ["n", {"@value": "m", "@language": "fr"}], "ex:k": {"@id": "ex:a"}}))
    df = rdf.read_rdf(spark, str(tmp_path))
    rows = {(r["s"], r["p"], r["o"], r["o_kind"], r["o_lang"]) for r in df.collect()}
    assert ("http://x/r", "http://x/p", "t", "literal", "de") in rows and ("http://x/j", "http://x/name", "m", "literal", "fr") in rows and ("http://x/j", "http://x/k", "http://x/a", "iri", None) in rows
    out = str(tmp_path / "nt")
    sinks.write_ntriples(df, out)
    back = rdf.read_ntriples(spark, out)
    assert back.count() == df.count() and {(r["p"], r["o"]) for r in back.collect()} == {(r[1], r[2]) for r in rows}
    assert sinks.ntriples(df, "g").where("value rlike '> [.]$'").count() == df.count()
    (tmp_path / "bad.ttl").write_text("ex:a ex:b")
    with pytest.raises(Exception, match="bad.ttl"):
        rdf.read_rdf(spark, str(tmp_path / "bad.ttl")).count()


def test_turtle_sink_can_be_read(spark, tmp_path):
    rows = [("http://x/a", iri("rdf:type"), iri("skos:Concept"), "iri", None), ("http://x/a", iri("skos:prefLabel"), 'q "x"', "literal", "en"), ("http://x/a", iri("skos:exactMatch"), "http://y/1", "iri", None), ("http://x/s", iri("rdf:type"), iri("skos:ConceptScheme"), "iri", None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")
    prefixes = {"y": "http://y/", "skos": "http://www.w3.org/2004/02/skos/core#", "rdf": rdf.RDF}
    sinks.write_turtle(df, str(tmp_path / "t"), prefixes)
    got = [t for f in (tmp_path / "t").glob("part*") if f.read_text() for t in rdf.Turtle(f.read_text()).parse()]
    assert {x[:3] for x in got} == {("http://x/a", rdf.RDF + "type", prefixes["skos"] + "Concept"), ("http://x/a", prefixes["skos"] + "prefLabel", 'q "x"'), ("http://x/a", prefixes["skos"] + "exactMatch", "http://y/1"), ("http://x/s", rdf.RDF + "type", prefixes["skos"] + "ConceptScheme")}
    xml = "".join(r[0] for r in sinks.rdf_xml(df.where(F.col("p") != iri("rdf:type"))).collect())
    assert len(rdf.rdf_xml(f'<rdf:RDF xmlns:rdf="{rdf.RDF}">{xml}</rdf:RDF>')) == 2


def test_owl_index(spark):
    o, r = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#label"
    rows = [("i1", rdf.RDF + "type", o + "Class"), ("i1", r, "Listeria  X"), ("i2", rdf.RDF + "type", o + "NamedIndividual"), ("i2", rdf.LABELS[1], "Celsius"), ("i2", rdf.SYNONYMS[1], "deg C"), ("i1", rdf.SYNONYMS[0], "Lx")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    index, syn = rdf.ontology_index(df)
    assert {(x["space"], x["label_norm"]) for x in index.collect()} == {("class", "listeria x"), ("individual", "celsius")}
    assert {(x["syn_norm"], x["canonical"]) for x in syn.collect()} == {("deg c", "Celsius"), ("lx", "Listeria  X")}
    assert rdf.ontology_index(df, "first")[0].count() == 1


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv(spark, tmp_path, sep):
    p = tmp_path / "m.csv"
    p.write_bytes(("﻿Term" + sep + " URI\nx" + sep + " y\n").encode())
    df = files.read_csv(spark, str(p), ["Term", "URI"])
    assert [tuple(r) for r in df.collect()] == [("x", "y")]
    with pytest.raises(ValueError, match="lacks"):
        files.read_csv(spark, str(p), ["Other"])
    p.write_text("Term\nx\n")
    with pytest.raises(ValueError, match="separator"):
        files.read_csv(spark, str(p))


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return b.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(xlsx([[" Term ", "URI1"], ["a", None], [None, "u"]]))
    spark.dataSource.register(files.Workbook)
    df = spark.read.format("workbook").load(str(tmp_path / "w.xlsx"))
    assert df.columns == ["Term", "URI1"] and {tuple(r) for r in df.collect()} == {("a", None), (None, "u")}


SBML = '<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" xmlns:comp="c"><model id="M1"><comp:listOfSubmodels><comp:submodel comp:id="s1" comp:modelRef="m1"/></comp:listOfSubmodels><listOfParameters><parameter id="p1"><comp:replacedBy comp:idRef="q1" comp:submodelRef="s1"/></parameter><parameter id="p2"/></listOfParameters></model><comp:externalModelDefinition comp:id="m1" comp:source="a/b.sbml"/></sbml>'


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.omex", "w") as z:
        z.writestr("manifest.xml", '<o:omexManifest xmlns:o="x"><o:content location="./a/model.sbml"/><o:content location="./a/metaData.json"/></o:omexManifest>')
        z.writestr("a/model.sbml", SBML)
        z.writestr("a/metaData.json", json.dumps({"modelMath": {"parameter": [{"id": "p1"}, {"id": "p1"}, {"id": "p2"}]}}))
        z.writestr("b/metaData.json", json.dumps({"modelMath": {"parameter": {"id": "p3"}}}))
        z.writestr("c/metaData.json", "{broken")
    (tmp_path / "bad.omex").write_text("no archive")
    m = files.archive_members(spark, str(tmp_path)).cache()
    assert m.where("error is not null").count() == 1 and m.where("member is not null").count() == 5
    assert {r["param_id"] for r in files.metadata_parameters(m.where("member is not null")).collect()} == {"p1", "p2", "p3"}
    texts = m.where("member is not null").select("archive", "member", F.col("content").cast("string").alias("text"))
    x = texts.where("member = 'manifest.xml'").select(files.manifest_locations(F.col("text")).alias("l")).first()["l"]
    assert x == ["a/model.sbml", "a/metaData.json"]
    sb = texts.where("member like '%.sbml'")
    assert sb.select(files.sbml_model_id(F.col("text")).alias("i")).first()["i"] == "M1"
    external, sub, links = files.sbml_links(sb, "text")
    assert [tuple(r) for r in external.collect()] == [("m1", "a/b.sbml")] and [tuple(r) for r in sub.collect()] == [("s1", "m1")] and [tuple(r) for r in links.collect()] == [("p1", "q1", "s1")]
    from semloom.operators import nested

    assert nested.is_joined(texts).first()["joined"]
    assert {r["model"] for r in nested.models_by_directory(texts).collect()} == {"a", "b", "c"}
    near = nested.nearest_metadata(texts.where("member like '%.sbml'").select("archive", "member"), texts.where("member like '%metaData.json'").select("archive", "member", F.lit(0).alias("ord")))
    assert [r["metadata"] for r in near.collect()] == ["a/metaData.json"]


def test_context():
    c = {"@context": {"ex": "http://x/", "name": "ex:n", "part": {"@id": "ex:part", "@context": {"name": "http://y/n"}}}}
    assert ("", "name", "http://x/n") in files.flatten_context(c) and ("part", "name", "http://y/n") in files.flatten_context(c)


def test_providers(spark):
    body = {"wikidata": {"search": [{"id": "Q1", "label": "L"}, {"id": "Q2", "concepturi": "u2"}]}, "bioportal": {"collection": [{"@id": "u", "prefLabel": "p", "definition": ["d1", "d2"], "links": {"ontology": "https://d/ontologies/FOO"}}]}, "ols": {"response": {"docs": [{"iri": "i", "label": "l", "description": ["x"], "ontology_name": "foo", "ontology_prefix": "FOO"}]}}, "geonames": {"geonames": [{"geonameId": 5, "name": "N", "fcodeName": "", "countryName": "C"}]}, "qudt": {"results": {"bindings": [{"uri": {"value": "k"}, "label": {"value": "Kelvin"}}]}}, "ncbi": {"items": [{"db": "taxonomy", "uid": "9", "scientificname": "S", "rank": "species"}, {"db": "pubmed", "uid": "7", "title": "T", "authors": [{"name": "A"}], "pubdate": "2020"}]}}
    rows = [("t", p, "completed", json.dumps(b)) for p, b in body.items()] + [("t", "olx", "completed", "{}"), ("t", "ols", "error", None), ("t", "ols", "completed", "{broken")]
    got = {(r["provider"], r["api_rank"]): r for r in providers.suggestions(spark.createDataFrame(rows, "term string, provider string, status string, body string")).collect()}
    assert len(got) == 8 and got["wikidata", 2]["uri"] == "u2" and got["wikidata", 2]["label"] == "N/A" and got["bioportal", 1]["description"] == "d1" and got["bioportal", 1]["ontology"] == "FOO"
    assert got["ols", 1]["source_provider"] == "FOO" and got["geonames", 1]["description"] == "C" and got["ncbi", 1]["uri"].endswith("id=9") and got["ncbi", 2]["description"] == "A (2020)"

    def fails(term):
        raise OSError("down")

    out = providers.fan_out(spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "term string"), {"x": lambda t: json.dumps({"t": t}), "y": fails}).collect()
    assert {(r["term"], r["provider"], r["status"]) for r in out} == {("a", "x", "completed"), ("a", "y", "error")}
    assert providers.fill_template('{{ "{term}" }} {limit}', 'a"b', 3) == '{ "a\\"b" } 3'
    order = providers.catalogue_order(spark.createDataFrame([("b",), ("a",), ("C",)], "name string"), ["c"])
    assert [r["name"] for r in order.collect()] == ["C", "A", "B"]


def test_csv_sink_with_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("x",)], "Term string"), str(tmp_path / "o"), bom=True)
    assert next((tmp_path / "o").glob("part*")).read_bytes().startswith(b"\xef\xbb\xbfTerm")


def test_grid_reads_only_its_partitions(spark, tmp_path):
    g = spark.createDataFrame([("tas", 1980, 1.0), ("tas", 1981, 2.0), ("pr", 1980, 3.0)], "variable string, year int, v double")
    g.write.partitionBy("variable", "year").parquet(str(tmp_path / "g"))
    out = files.read_grid(spark, str(tmp_path / "g"), "tas", 1980, 1980)
    assert [r["v"] for r in out.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(variable" in out._jdf.queryExecution().executedPlan().toString()
