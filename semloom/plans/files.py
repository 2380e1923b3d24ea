"""Queries of sources and sinks: what the tables hold is written to the shared folder in each format and read again; recorded answers of providers; archives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators import cache, nested, skos
from semloom.operators.vocabulary import iri
from semloom.plans.graph import T, V, full, triples
from semloom.plans.query import Queries, sql_normalize
from semloom.session import fresh_folder
from semloom.sources import files, providers, rdf, sinks

query = Queries()
_TRIPLES = T + "select distinct s, p, o from triples"


def _rows(load) -> DataFrame:
    return load("suggestion").select(F.col("suggestion_id").cast("string").alias("suggestion_id"), *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("label", "description", "provider")))


_ROWS = "select cast(suggestion_id as varchar) as suggestion_id, trim(coalesce(label, ''), ' ') as label, trim(coalesce(description, ''), ' ') as description, provider from suggestion"


@query(_ROWS)
def s1_csv(load):
    """S1/K1. Delimited text with a byte order mark, written and read."""
    df = _rows(load)
    path = fresh_folder(df.sparkSession)
    sinks.write_csv(df, path, bom=True)
    return files.read_csv(df.sparkSession, path, required=["label"]).fillna("")


@query(_ROWS)
def k5_json(load):
    """K5."""
    df = _rows(load)
    path = fresh_folder(df.sparkSession)
    sinks.write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


@query("select cast(row_id as varchar) as row_id, coalesce(conceptgroup, '') as conceptgroup, coalesce(uri1, '') as uri1 from master_mapping")
def s2_workbook(load):
    """S2/K2. Workbooks written and read."""
    df = load("master_mapping").select(F.col("row_id").cast("string").alias("row_id"), F.coalesce("conceptgroup", F.lit("")).alias("conceptgroup"), F.coalesce("uri1", F.lit("")).alias("uri1"))
    path = fresh_folder(df.sparkSession)
    sinks.write_workbooks(df, path).count()
    df.sparkSession.dataSource.register(files.Workbook)
    return df.sparkSession.read.format("workbook").load(path).fillna("")


def _written(load, write, read) -> DataFrame:
    t = triples(load)
    path = fresh_folder(t.sparkSession)
    write(t, path)
    return read(t.sparkSession, path).select("s", "p", "o").distinct()


@query(_TRIPLES)
def s3_turtle(load):
    """S3/S4/K3/J17. Turtle written and read."""
    return _written(load, lambda t, p: sinks.write_turtle(t, p, {"agr": "https://vocab.agrisem.example/class/"}), lambda s, p: rdf.read_rdf(s, p, kind="ttl"))


@query(_TRIPLES)
def k4_ntriples(load):
    """K4. N-Triples written and read."""
    return _written(load, sinks.write_ntriples, lambda s, p: rdf.read_ntriples(s, p))


@query(_TRIPLES)
def k4_rdf_xml(load):
    """K4. RDF/XML written and read."""
    return _written(load, sinks.write_rdf_xml, lambda s, p: rdf.read_rdf(s, p, kind="rdf"))


@query(_TRIPLES)
def k4_jsonld(load):
    """K4. JSON-LD written and read."""
    return _written(load, lambda t, p: sinks.write_jsonld(t, p, {"schema": "https://schema.org/"}), lambda s, p: rdf.read_rdf(s, p, kind="jsonld"))


@query(T + "select distinct case when starts_with(s, 'param:') then 'https://g.example/param' else 'https://g.example/rest' end as g, s, p, o from triples")
def k4_trig(load):
    """K4. TriG written and read, parameters in a graph of their own."""
    t = triples(load).withColumn("g", F.when(F.col("s").startswith("param:"), "https://g.example/param").otherwise("https://g.example/rest"))
    path = fresh_folder(t.sparkSession)
    sinks.write_trig(t, path, {})
    return rdf.read_rdf(t.sparkSession, path, kind="trig").select("g", "s", "p", "o").distinct()


@query(T + "select distinct case when starts_with(s, 'param:') then 'https://g.example/param' end as g, s, p, o from triples")
def k4_nquads(load):
    """K4. N-Quads written and read; what is in no graph has none."""
    t = triples(load).withColumn("g", F.when(F.col("s").startswith("param:"), "https://g.example/param"))
    path = fresh_folder(t.sparkSession)
    sinks.write_ntriples(t, path, graph="g")
    return rdf.read_ntriples(t.sparkSession, path).select("g", "s", "p", "o").distinct()


def _ontology(load) -> DataFrame:
    spaces = {v: k for k, v in rdf.SPACES.items()}
    i = load("ontology_index")
    kind = F.create_map(*(F.lit(x) for kv in spaces.items() for x in kv))
    row = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    own = i.select(F.col("iri").alias("s"), F.inline(F.array(row(rdf.RDF + "type", F.element_at(kind, F.col("space"))), row(rdf.LABELS[0], F.col("label")))))
    named = load("ontology_synonym").join(i, F.col("canonical") == F.col("label"))
    return own.where("o is not null").unionByName(named.select(F.col("iri").alias("s"), F.lit(rdf.SYNONYMS[1]).alias("p"), F.col("syn_norm").alias("o")))


@query(f"select distinct space, label, {sql_normalize('label')} as label_norm, iri from ontology_index")
def s5_ontology_index(load):
    """S5. The index of an ontology's labels."""
    return rdf.ontology_index(_ontology(load))[0].select("space", "label", "label_norm", "iri").distinct()


@query(f"""with f as (select iri, min(label) as canonical from ontology_index group by iri), n as (select {sql_normalize("syn_norm")} as syn_norm, i.iri, f.canonical from ontology_synonym y join ontology_index i on y.canonical = i.label join f on f.iri = i.iri)
select syn_norm, arg_min(canonical, (iri, canonical)) as canonical from n group by syn_norm""")
def s6_synonyms(load):
    """S6. The index of an ontology's synonyms."""
    return rdf.ontology_index(_ontology(load))[1].select("syn_norm", "canonical")


def archives(load) -> DataFrame:
    """Zip archives, one per model, written to the shared folder: a manifest, metadata at two levels, a model file that links to another."""
    p = load("model_parameter").groupBy("model_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    models = load("models").select("model_id").join(p, "model_id", "left").repartition(4, "model_id")
    path = fresh_folder(models.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        place, base = files.file_system(path)
        place.create_dir(base, recursive=True)
        for b in batches:
            for model, ids in zip(b["model_id"], b["ids"]):
                ids = [] if ids is None else list(ids)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("manifest.xml", '<omexManifest xmlns="urn:o"><content location="./a/model.sbml"/><content location="metaData.json"/></omexManifest>')
                    z.writestr("metaData.json", json.dumps({"modelMath": {"parameter": [{"id": i} for i in ids]}}))
                    z.writestr("a/metaData.json", json.dumps({"modelMath": {"parameter": {"id": "one"}}}))
                    z.writestr("a/b/deep.sbml", '<sbml><model id="deep"/></sbml>')
                    z.writestr("a/model.sbml", f'<sbml xmlns:comp="urn:c"><model id="{model}"><comp:listOfSubmodels><comp:submodel comp:id="S" comp:modelRef="E"/></comp:listOfSubmodels><listOfParameters><parameter id="t"><comp:replacedBy comp:idRef="s1" comp:submodelRef="S"/></parameter></listOfParameters></model><comp:externalModelDefinition comp:id="E" comp:source="x.sbml"/></sbml>')
                with place.open_output_stream(f"{base}/{model}.zip") as f:
                    f.write(out.getvalue())
            yield pd.DataFrame({"model_id": b["model_id"]})

    models.mapInPandas(run, "model_id string").count()
    return files.archive_members(models.sparkSession, path).withColumn("model_id", F.regexp_extract("archive", r"([^/]+)\.zip$", 1))


_MEMBERS = "(values ('manifest.xml'), ('metaData.json'), ('a/metaData.json'), ('a/b/deep.sbml'), ('a/model.sbml')) v(member)"


@query(f"select model_id, member from models, {_MEMBERS}")
def s7_members(load):
    """S7. Members of every archive."""
    return archives(load).select("model_id", "member")


@query("select model_id, unnest(['a/model.sbml', 'metaData.json']) as location from models")
def s8_manifest(load):
    """S8. What the manifests list."""
    m = archives(load).where("member = 'manifest.xml'")
    return m.select("model_id", F.explode(files.manifest_locations(F.col("content").cast("string"))).alias("location"))


@query("select model_id, 'S' as alias, 'E' as model_ref, 'x.sbml' as source, 't' as target_param, 's1' as source_param, model_id as sbml_id from models")
def s9_links(load):
    """S9/S10/J8. Submodels, external models and linked parameters of model files, with the model's own id."""
    m = archives(load).where("member = 'a/model.sbml'").withColumn("xml", F.col("content").cast("string"))
    external, sub, links = files.sbml_links(m, "xml", "model_id")
    named = m.select("model_id", files.sbml_model_id(F.col("xml")).alias("sbml_id"))
    joined = sub.join(external.withColumnRenamed("id", "model_ref"), ["model_id", "model_ref"]).join(links.withColumnRenamed("source_alias", "alias"), ["model_id", "alias"])
    return joined.join(named, "model_id").select("model_id", "alias", "model_ref", "source", "target_param", "source_param", "sbml_id")


@query("select distinct model_id, id as param_id from model_parameter where id <> '' and model_id in (select model_id from models) union select model_id, 'one' from models")
def s11_parameters(load):
    """S11. Ids of parameters in the metadata of every archive."""
    return files.metadata_parameters(archives(load)).select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("model_id"), "param_id")


@query("select model_id, true as joined from models")
def j6_joined(load):
    """J6. Archives that hold several models."""
    m = archives(load).select(F.col("model_id").alias("archive"), "member", F.col("content").cast("string").alias("text"))
    return nested.is_joined(m).select(F.col("archive").alias("model_id"), "joined")


@query("select model_id, 'a' as model from models")
def j7_directories(load):
    """J7. Models by the directory of their metadata."""
    return nested.models_by_directory(archives(load).withColumn("archive", F.col("model_id"))).select(F.col("archive").alias("model_id"), "model")


@query("select model_id, unnest(['a/model.sbml', 'a/b/deep.sbml']) as member, 'a/metaData.json' as metadata from models")
def j9_nearest(load):
    """J9/J-near. The nearest metadata of every model file."""
    m = archives(load).select(F.col("model_id").alias("archive"), "member")
    meta = m.where(F.col("member").endswith("metaData.json")).withColumn("ord", F.lit(0))
    return nested.nearest_metadata(m.where(F.col("member").endswith(".sbml")), meta).withColumnRenamed("archive", "model_id")


@query("select 'http://x.example/' || n_regionkey || '/' as namespace, 'n' || n_nationkey as prefix from nation")
def s13_prefix_lines(load):
    """S13. Prefix lines of both spellings among others."""
    n = load("nation")
    line = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "@prefix n").otherwise("  PREFIX n"), F.col("n_nationkey").cast("string"), F.lit(": <http://x.example/"), F.col("n_regionkey").cast("string"), F.lit("/> ."))
    lines = n.select(line.alias("value")).unionByName(n.select(F.concat(F.lit("# "), "n_name").alias("value")))
    path = fresh_folder(n.sparkSession)
    lines.write.text(path)
    return skos.read_prefixes(n.sparkSession.read.text(path)).select("namespace", "prefix")


@query("select 'https://s.example/' || n_name as iri, n_name as key, '' as scope from nation union all select 'https://s.example/inner', 'name', n_name from nation")
def s15_context(load):
    """S15. A context with scopes, written as a file and read."""
    n = load("nation")
    terms = n.select(F.to_json(F.map_from_arrays(F.array("n_name"), F.array(F.struct(F.concat(F.lit("s:"), "n_name").alias("@id"), F.struct(F.struct(F.lit("s:inner").alias("@id")).alias("name")).alias("@context"))))).alias("t"))
    doc = terms.agg(F.concat(F.lit('{"@context": {"s": "https://s.example/", '), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.regexp_replace(t, r"^\{|\}$", "")), ", "), F.lit("}}")).alias("value"))
    path = fresh_folder(n.sparkSession)
    doc.coalesce(1).write.text(path)
    found = files.read_context(n.sparkSession, path)
    # The prefix itself is a term of the context too.
    return found.where("key <> 's'").withColumn("iri", F.regexp_replace("iri", "^s:", "https://s.example/")).select("iri", "key", "scope")


_FIRST = "(select term_id, label, description, uri, id, ontology, suggestion_id, row_number() over (partition by term_id order by suggestion_id) as k from suggestion where label is not null and uri is not null and id is not null)"


@query(f"""with s as (select cast(term_id as varchar) as term, label, coalesce(description, '') as d, uri, id, k from {_FIRST})
select term, 'wikidata' as provider, cast(k as integer) as api_rank, uri, label, d as description, 'Wikidata' as source_provider from s
union all select term, 'ols', k, uri, label, d, 'OLX' from s union all select term, 'semlookp', k, uri, label, d, 'olx' from s
union all select term, 'bioportal', k, uri, label, d, 'FPX' from s union all select term, 'agroportal', k, uri, label, d, 'FPX' from s union all select term, 'earthportal', k, uri, label, d, 'FPX' from s
union all select term, 'geonames', k, 'https://sws.geonames.org/' || id || '/', label, 'town, land', 'GeoNames' from s
union all select term, 'qudt', k, uri, label, d, 'qudt' from s union all select term, 'custom', k, uri, label, d, 'custom' from s union all select term, 'agrovoc', k, uri, label, d, 'agrovoc' from s
union all select term, 'ncbi', k, 'https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=' || id, label, 'species', 'NCBI taxonomy' from s""")
def provider_suggestions(load):
    """P1-P8, P11, P12. Every suggestion as each provider would answer with it, recorded and read."""
    s = load("suggestion").where("label is not null and uri is not null and id is not null").select(F.col("term_id").cast("string").alias("term"), "suggestion_id", "uri", "label", F.coalesce("description", F.lit("")).alias("d"), "id")
    lit, c = F.lit, F.col
    binding = F.struct(F.struct(c("uri").alias("value")).alias("uri"), F.struct(c("label").alias("value")).alias("label"), F.struct(c("d").alias("value")).alias("description"))
    portal = F.struct(c("uri").alias("@id"), c("label").alias("prefLabel"), F.array("d").alias("definition"), F.struct(lit("https://data.example/ontologies/fpx").alias("ontology")).alias("links"))
    item = {
        "wikidata": F.struct("id", c("uri").alias("concepturi"), "label", c("d").alias("description")), "ncbi": F.struct(lit("taxonomy").alias("db"), c("id").alias("uid"), c("label").alias("scientificname"), lit("species").alias("rank")),
        "ols": F.struct(c("uri").alias("iri"), "label", F.array("d").alias("description"), lit("OLX").alias("ontology_prefix")), "semlookp": F.struct(c("uri").alias("iri"), "label", F.array("d").alias("description"), lit("olx").alias("ontology_name")),
        "geonames": F.struct(c("id").alias("geonameId"), c("label").alias("name"), lit("town").alias("fcodeName"), lit("").alias("adminName1"), lit("land").alias("countryName")),
        **dict.fromkeys(("bioportal", "agroportal", "earthportal"), portal), **dict.fromkeys(("qudt", "custom", "agrovoc"), binding),
    }
    responses = None
    for name, made in item.items():
        steps = providers.PROVIDERS[name][0].split(".")[1:]
        items = F.transform(F.array_sort(F.collect_list(F.struct("suggestion_id", made.alias("x")))), lambda v: v["x"])
        # A term has a few suggestions; this puts together what a service would give as one answer.
        body = items.alias(steps[-1])
        for step in reversed(steps[:-1]):
            body = F.struct(body).alias(step)
        part = s.groupBy("term").agg(F.to_json(F.struct(body)).alias("body")).select("term", F.lit(name).alias("provider"), F.lit("completed").alias("status"), "body")
        responses = part if responses is None else responses.unionByName(part)
    return providers.suggestions(responses).select("term", "provider", "api_rank", "uri", "label", "description", "source_provider")


@query("select provider, case when provider = 'bad' then 'error' else 'completed' end as status, n as terms from (values ('good'), ('bad')) p(provider), (select count(distinct unit_name) as n from unit_reference)")
def m14_fan_out(load):
    """J-multi/M14. Every unit's name asked at two connectors, one of which fails for some names."""

    def bad(term: str) -> str:
        if "gram" in term:
            raise ValueError("refused")
        return "{}"

    asked = load("unit_reference").select(F.col("unit_name").alias("term"))
    return providers.provider_status(providers.fan_out(asked, {"good": lambda term: json.dumps({"q": term}), "bad": bad}, parallel=2))


@query("select upper(provider) as name, cast(row_number() over (order by case upper(provider) when 'OLX' then 0 when 'LOCALGRAPH' then 1 else 2 end, upper(provider)) as integer) as place from (select distinct provider from suggestion)")
def catalogue_order(load):
    """P13/P14. The providers, the preferred ones first."""
    names = providers.catalogue_order(load("suggestion").select(F.col("provider").alias("name")), ["olx", "localgraph"])
    # A catalogue is a short list; its order is what is asked for.
    return names.agg(F.collect_list("name").alias("names")).select(F.posexplode("names").alias("i", "name")).select("name", (F.col("i") + 1).cast("int").alias("place"))


_CACHE = "(select uri as key, arg_max(label, (retrieved_at, suggestion_id)) as value, max(retrieved_at) as cached_at from suggestion where uri is not null and retrieved_at is not null group by uri)"


def _cache(load) -> DataFrame:
    s = load("suggestion").where("uri is not null and retrieved_at is not null")
    return s.groupBy(F.col("uri").alias("key")).agg(F.max_by("label", F.struct("retrieved_at", "suggestion_id")).alias("value"), F.max("retrieved_at").cast("timestamp").alias("cached_at"))


@query(f"with c as {_CACHE}, n as (select max(cached_at) as now from c) select key, value from c, n where cached_at >= now - interval 7 day union all select uri, null from (select distinct uri1 as uri from master_mapping where uri1 <> '') where uri not in (select key from c, n where cached_at >= now - interval 7 day)")
def c1_lookup(load):
    """C1. Keys looked up in a cache whose entries last a week: all of the cache that are fresh, and mapped uris that aren't."""
    c = _cache(load)
    now = c.agg(F.max("cached_at")).first()[0]
    fresh = cache.active(c, now)
    wanted = fresh.select("key").unionByName(load("master_mapping").where("uri1 <> ''").select(F.col("uri1").alias("key"))).distinct()
    return cache.lookup(wanted, c, "key", now).select("key", "value")


@query(f"with c as {_CACHE}, n as (select max(cached_at) as now from c) select count(*) as total, count(*) filter (cached_at >= now - interval 7 day) as active, count(*) filter (not cached_at >= now - interval 7 day) as expired from c, n")
def a9_cache_stats(load):
    """A9. Counts of active and expired entries."""
    c = _cache(load)
    return cache.stats(c, c.agg(F.max("cached_at")).first()[0])


@query("select provider as kind, count(*) as total, count(uri) as succeeded, count(*) - count(uri) as failed from suggestion group by 1")
def a9_counts(load):
    """A9. Successes and failures by kind."""
    return cache.format_counts(load("suggestion").select(F.col("provider").alias("kind"), F.col("uri").isNotNull().alias("ok")), "kind", "ok")


@query(full("""with u as (select distinct model_id, id, regexp_replace(id, '\\d+$', '') as stem from model_parameter where id <> ''), f as (select model_id, stem, min('https://p.example/' || model_id || '/' || id) as iri from u group by 1, 2),
m as (select model_id, lead(model_id) over (order by model_id) as next from models), l as (select distinct a.iri as target, b.iri as source from m join f a on a.model_id = m.model_id join f b on b.model_id = m.next and a.stem = b.stem)
select 'https://p.example/all' as s, 'rdf:type' as p, 'https://meta.example/CompositeModel' as o union select 'https://p.example/all', 'dct:hasPart', 'https://p.example/' || model_id from models union select target, 'prov:wasInformedBy', source from l"""))
def j5_composite(load):
    """J5. One composite of all models, whose parameters are informed by those of like name of the next model."""
    from pyspark.sql import Window

    p = load("model_parameter").where("id <> ''").select("model_id", F.col("id").alias("param_id"), F.concat(F.lit("https://p.example/"), "model_id", F.lit("/"), "id").alias("iri"))
    # The models stand for the members of one archive, a short list in order.
    pairs = load("models").select("model_id", F.lead("model_id").over(Window.orderBy("model_id")).alias("next")).where("next is not null")
    links = pairs.join(p.select("model_id", "param_id").distinct(), "model_id").select(F.col("model_id").alias("target_alias"), F.col("param_id").alias("target_param"), F.col("next").alias("source_alias"), F.col("param_id").alias("source_param"))
    found = nested.parameter_links(links, load("models").select(F.col("model_id").alias("alias"), "model_id"), p)
    whole = F.lit("https://p.example/all")
    parts = load("models").select(whole.alias("composite"), F.concat(F.lit("https://p.example/"), "model_id").alias("part"))
    return nested.composite(load("models").limit(1).select(whole.alias("iri")), parts, found, V.composite, V).select("s", "p", "o")


@query("select model_id from models intersect select model_id from model_parameter where exported_by = 'manual'")
def u3_both(load):
    """U3. Models that are known and processed."""
    return nested.in_both(load("models"), load("model_parameter").where("exported_by = 'manual'"))


def _report(load) -> DataFrame:
    from semloom.plans.skos_climate import _wide

    mapped = load("master_mapping").select("row_id", F.array(F.struct(F.lit("skos:exactMatch").alias("match_type"), F.col("uri1").alias("uri")), F.struct(F.lit("skos:exactMatch").alias("match_type"), F.col("uri2").alias("uri"))).alias("mappings"))
    wide, t = _wide(load).join(mapped, "row_id"), triples(load)
    added = skos.upsert(wide, t, "https://sem.example/")
    named = added.where(F.col("p") == iri("skos:exactMatch")).select("s", F.lit("skos:exactMatch").alias("match_type"), F.col("o").alias("uri"))
    return skos.report(added, skos.conflicts(named, t))


@query()
def a14_report(load):
    """A14. What an upsert added, changed and found in conflict, each once and in order."""
    return _report(load)


QUERIES, SQL = query.queries, query.sql
