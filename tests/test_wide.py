from semloom.operators.vocabulary import iri
from semloom.plans import registry


def test_every_mapping_is_added(spark, data, tmp_path):
    import shutil

    for t in ("ontology_index", "ontology_synonym", "models", "model_parameter"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path)
    m = spark.createDataFrame([(1, "Möhre", "carotte râpée,\n\tcarrot zz", "Gemüse", None, None, None, "Wurzel"), (2, "plain zz", None, None, None, None, None, None)], "row_id long, term string, altlabels string, conceptgroup string, uri1 string, uri2 string, uri3 string, providerterm1 string")
    m.write.parquet(str(tmp_path / "master_mapping.parquet"))
    got = {(r["p"], r["o"]) for r in registry.QUERIES["j12_upsert"](spark, str(tmp_path)).collect()}
    assert {(iri("skos:prefLabel"), "Möhre"), (iri("skos:altLabel"), "carotte râpée"), (iri("skos:altLabel"), "carrot zz"), (iri("skos:definition"), "Wurzel"), (iri("skos:prefLabel"), "plain zz"), (iri("dct:title"), "Gemüse Vocabulary")} <= got
    found = {r["term"]: (r["concept"], r["is_new"]) for r in registry.QUERIES["j12_concept_of_term"](spark, str(tmp_path)).collect()}
    assert found == {"Möhre": ("https://sem.example/concept/gemüse/möhre", True), "plain zz": ("https://sem.example/concept/plain-zz", True)}
