"""Queries of inference and nested metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators import cascade, inference, nested
from semloom.plans.query import Queries, sql_keywords, sql_sanitize

query = Queries()


def documents(load) -> DataFrame:
    """(model_id, doc): a metadata document per model, with its parameters as objects."""
    p = load("model_parameter")
    one = F.struct(F.col("id"), F.col("name"), F.col("classification"), F.col("unittext").alias("unit"), F.col("datatype").alias("dataType"), F.col("value"))
    # A model has a bounded number of parameters; this puts together what a source would give as one file.
    params = p.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("param_key", one.alias("x")))), lambda v: v["x"]).alias("parameter"))
    m = load("models").join(params, "model_id")
    doc = F.struct(
        F.struct(F.col("model_id").alias("identifier"), F.col("title").alias("name"), F.col("software"), F.struct(F.col("model_class").alias("modelClass"), F.lit("x").alias("note")).alias("modelCategory")).alias("generalInformation"),
        F.struct(F.array(F.struct(F.col("title").alias("name"), F.lit("1").alias("rank"))).alias("hazard")).alias("scope"), F.struct(F.col("parameter")).alias("modelMath"),
    )
    return m.select("model_id", F.to_json(doc).alias("doc"))


@query("""select model_id, count(id) as ids, count(name) as names, count(value) as vals from model_parameter where model_id in (select model_id from models) group by 1""")
def j1_walk(load):
    """J1. Documents walked into nodes: what became of the parameters' fields."""
    n = nested.walk(documents(load), "model_id", "doc").where("path like 'modelMath.parameter.%' and kind = 'string'")
    return n.groupBy("model_id").agg(F.count_if(F.col("key") == "id").alias("ids"), F.count_if(F.col("key") == "name").alias("names"), F.count_if(F.col("key") == "value").alias("vals"))


_FIELDS = (("classification", "classification"), ("dataType", "datatype"), ("id", "id"), ("name", "name"), ("unit", "unittext"), ("value", "value"))
#: The scalar fields of a parameter as JSON, those that are null left out.
_CONTENT = "'{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || cast(to_json({c}) as varchar)" for k, c in _FIELDS) + ") || '}'"


@query(f"""select 'https://sem.example/' || {sql_sanitize("model_id")} || '/parameter/' || coalesce(nullif({sql_sanitize("nullif(id, '')")}, ''), substr(md5({_CONTENT}), 1, 8)) as iri, count(*) as n from model_parameter where model_id in (select model_id from models) group by 1""")
def j1_parameter_ids(load):
    """J1/X24. Ids of all parameter objects."""
    ids = nested.identified(nested.walk(documents(load), "model_id", "doc"), "https://sem.example/")
    return ids.where("path = 'modelMath.parameter'").groupBy("iri").agg(F.count(F.lit(1)).alias("n"))


@query()
def j1_identified(load):
    """J1/X25. All ids, categories and hazards by the ontology where it knows them."""
    nodes = nested.walk(documents(load), "model_id", "doc")
    asked = nested.field_values(nodes, {"organisms": ("name",), "classifications": ("modelClass",)})
    values = asked.select("text", F.when(F.col("field") == "name", "hazard").otherwise("modelCategory").alias("field"))
    found = cascade.match_ontology(values.withColumn("field", F.when(F.col("field") == "hazard", "hazard").otherwise("modelClass")), load("ontology_index"), load("ontology_synonym"), near=False)
    ontology = found.where("iri is not null").select(F.when(F.col("field") == "modelClass", "modelCategory").otherwise(F.col("field")).alias("field"), "text", "iri")
    return nested.identified(nodes, "https://sem.example/", ontology)


@query("""select distinct 'units' as category, 'unit' as field, unittext as text from model_parameter where unittext <> '' and model_id in (select model_id from models)
union select distinct 'classifications', 'classification', classification from model_parameter where classification <> '' and model_id in (select model_id from models)
union select distinct 'general', 'software', software from models where software <> '' and model_id in (select model_id from model_parameter)
union select distinct 'classifications', 'modelClass', model_class from models where model_class <> '' and model_id in (select model_id from model_parameter)""")
def j4_field_values(load):
    return nested.field_values(nested.walk(documents(load), "model_id", "doc"), cascade.VOCABULARY_FIELDS)


@query()
def j2_triples(load):
    """J2/J3. Documents as triples, keys by a scoped context."""
    nodes = nested.walk(documents(load), "model_id", "doc")
    context = nodes.sparkSession.createDataFrame([("", "name", "schema:name"), ("modelMath.parameter", "id", "dct:identifier"), ("", "id", "schema:identifier"), ("generalInformation", "name", "dct:title")], "scope string, key string, iri string")
    return nested.to_triples(nested.with_context(nodes, context, "https://sem.example/vocab/"), nested.identified(nodes, "https://sem.example/"))


@query("""select event_id, cast(json_extract(props, '$.k') as varchar) as k from events where json_valid(props)""")
def j1_event_props(load):
    """J1 over the events' JSON."""
    n = nested.walk(load("events"), "event_id", "props")
    return n.where("path = 'k'").select(F.col("model_id").cast("long").alias("event_id"), F.col("value").alias("k"))


@query("""select cast(event_id as varchar) as name, case event_id % 4 when 0 then json_valid(props) when 1 then false when 2 then true else false end as valid from events""")
def j10_validity(load):
    """J10. Every event's JSON: as it is, cut off, as a linked node, and with an id that is no text."""
    e, i = load("events"), F.col("event_id") % 4
    node = F.concat(F.lit('{"@context": {"v": "https://sem.example/v/", "props": "v:props"}, "@id": "v:1", "props": "'), F.hex("props"), F.lit('"}'))
    doc = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("["), "props")).when(i == 2, node).otherwise(F.lit('{"@id": 5, "v": 1}'))
    return nested.validity(e.withColumn("doc", doc), "event_id", "doc").select("name", "valid")


@query("""select coalesce(m.model_id, p.model_id) as model_id, coalesce(nullif(title, ''), nullif(source_file, ''), m.model_id, p.model_id) as title, case when m.model_id is null then 'only processed' when p.model_id is null then 'new' else 'processed' end as status
from models m full join (select distinct model_id from model_parameter where exported_by = 'manual') p on m.model_id = p.model_id""")
def j18_statuses(load):
    return nested.statuses(load("models"), load("model_parameter").where("exported_by = 'manual'"))


def _candidates(load, groups: list[str]) -> DataFrame:
    m = load("master_mapping").where(F.col("conceptgroup").isin(*groups) & F.col("term").isNotNull())
    return m.groupBy("term").agg(F.min("row_id").alias("ord"), F.min_by("altlabels", "row_id").alias("alts")).select(F.col("term").alias("display"), "ord", "term", "alts")


@query()
def mt4_infer(load):
    """MT4. Units and parameters of every model's parameters, inferred from the mapping table."""
    p = load("model_parameter").select(F.col("model_id").alias("model"), F.col("id").alias("param_id"), "name", F.coalesce(F.nullif("unittext", F.lit("")), "unit_label").alias("unit"), F.array(F.upper(F.coalesce("classification", F.lit("")))).alias("roles")).where("param_id is not null")
    units = load("unit_reference").select(F.col("unit_name").alias("display"), F.crc32("unit_code").alias("ord"), F.col("unit_name").alias("term"), F.col("symbol").alias("alts"))
    return inference.infer(p, units, _candidates(load, ["InputParameter", "Parameter"]), _candidates(load, ["OutputParameter", "Parameter"])).withColumn("roles", F.array_join("roles", ","))


@query(f"""with q as (select distinct name as text, {sql_keywords("name")} as w from model_parameter where name is not null),
c as (select label as display, concept_id as ord, {sql_keywords("label")} as v from ontology_index where space = 'property'),
qw as (select text, unnest(w) as a from q), cv as (select display, ord, unnest(v) as b from c),
s as (select text, display, ord, round(sum(case when a = b then 1.0e0 else 0.8e0 end), 6) as score from qw join cv on contains(a, b) or contains(b, a) group by 1, 2, 3)
select text, display, score from s qualify row_number() over (partition by text order by score desc, ord, display desc) = 1""")
def x8_keyword_match(load):
    """X8 as a matcher: every parameter name against the properties of the reference list."""
    names = load("model_parameter").where("name is not null").select(F.col("name").alias("text"))
    c = load("ontology_index").where("space = 'property'").select(F.col("label").alias("display"), F.col("concept_id").alias("ord"), F.col("label").alias("term"), F.lit(None).cast("string").alias("alts"))
    return inference.match_keywords(names, c)


@query()
def x9_unit_match(load):
    """X9/X10. Every unit text against the units of the reference list."""
    u = load("unit_reference").select(F.col("unit_name").alias("display"), F.crc32("unit_code").alias("ord"), F.col("unit_name").alias("term"), F.col("symbol").alias("alts"))
    return inference.match_units(load("model_parameter").select(F.col("unittext").alias("text")), u)


@query()
def mt5_wire(load):
    """X11/MT5/J16. Among the suggestions of each term the one whose texts fit best, as mapping nodes.

    A candidate is a uri; its texts are all labels its suggestions give, its last part as the variable's name, and its id.
    Search texts are the term with the alternative labels and the provider's term of its first mapping.
    """
    m = load("master_mapping").where("term is not null").groupBy("term").agg(F.min(F.struct("row_id", "altlabels", "providerterm1")).alias("m"))
    terms = load("matching_table_for_reconciliation").select("term_id", "term", "provider_term").join(m, "term", "left")
    name = F.substring_index("uri", "/", -1)
    pairs = load("suggestion").where("uri <> ''").groupBy("term_id", "uri").agg(F.min("suggestion_id").alias("ord"), F.array_sort(F.collect_set("label")).alias("labels"), F.min(F.nullif("id", F.lit(""))).alias("id"))
    search = F.array("term", "m.altlabels", F.coalesce(F.nullif("provider_term", F.lit("")), "m.providerterm1"))
    best = inference.disambiguate(pairs.join(terms, "term_id"), "term_id", "uri", search, F.concat("labels", F.array(name, F.coalesce("id", name))), "ord")
    wired = best.select(F.concat(F.lit("term:"), "term_id").alias("model"), F.concat(F.lit("param:"), "term_id").alias("parameter"), F.col("uri").alias("source"), name.alias("variable"))
    return inference.input_mappings(wired, "https://sem.example/linking/")


QUERIES, SQL = query.queries, query.sql
