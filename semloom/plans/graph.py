"""Graph queries over triples made of the domain tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.functions.text import strip
from semloom.operators import graph as G
from semloom.operators.vocabulary import NAMESPACES, Vocabulary
from semloom.plans.query import Queries, sql_strip
from semloom.session import shared_folder

query = Queries()
BASE = "https://meta.example/"
V = Vocabulary.of(BASE)
#: The class that a number at the end of a classification's iri stands for.
CODES = {"17481": "INPUT"}


def full(sql: str) -> str:
    """SQL with the IRIs of the CURIEs in quotes."""
    names = {**NAMESPACES, "meta": BASE}
    return re.sub(r"'(\w+):(\w+)'", lambda m: f"'{names[m[1]]}{m[2]}'" if m[1] in names else m[0], sql)


def triples(load) -> DataFrame:
    """s, p, o, o_kind, o_lang of the reference list, its synonyms, the models with their scope, their parameters and the mappings."""
    lit = F.lit

    def rows(df: DataFrame, s, p: str, o, kind: str, lang: str | None = None) -> DataFrame:
        return df.select(s.alias("s"), lit(p).alias("p"), o.alias("o"), lit(kind).alias("o_kind"), lit(lang).cast("string").alias("o_lang")).where("o is not null")

    index, models, params, mapping = load("ontology_index"), load("models"), load("model_parameter"), load("master_mapping")
    named = load("ontology_synonym").join(index, F.col("canonical") == F.col("label")).select("iri", "syn_norm")
    model, param, row = F.concat(lit("model:"), "model_id"), F.concat(lit("param:"), "param_key"), F.concat(lit("map:"), "row_id")
    # A title names the hazard and the product, here linked by way of a scope node or (odd numbers) directly.
    half = lambda i: F.lower(F.trim(F.get(F.split("title", " / "), lit(i))))
    label = index.groupBy("label_norm").agg(F.min("iri").alias("iri"))
    linked = lambda i: models.where(F.col("title").contains(" / ")).withColumn("label_norm", half(i)).join(label, "label_norm")
    direct = F.col("model_id").rlike("[13579]$")
    scope = F.concat(lit("scope:"), "model_id")
    parts = [
        rows(index, F.col("iri"), V.type, lit(V.concept), "iri"), rows(index, F.col("iri"), V.pref_label, F.col("label"), "literal", "en"),
        rows(index, F.col("iri"), V.in_scheme, F.concat(lit("https://sem.example/scheme/"), "space"), "iri"), rows(named, F.col("iri"), V.alt_label, F.col("syn_norm"), "literal", "en"),
        rows(models, model, V.type, lit(V.model), "iri"), rows(models, model, V.identifier[0], F.col("model_id"), "literal"), rows(models, model, V.name, F.col("title"), "literal"),
        rows(models.where(~direct), model, V.has_scope, scope, "iri"),
        *(rows(linked(i), F.when(direct, model).otherwise(scope), p, F.col("iri"), "iri") for i, p in ((0, V.hazard), (1, V.product))),
        rows(params, model, V.has_parameter[0], param, "iri"), rows(params, param, V.param_id, F.col("id"), "literal"), rows(params, param, V.name, F.col("name"), "literal"),
        rows(params, param, V.unit, F.col("unittext"), "literal"), rows(params, param, V.classification, F.col("classification"), "literal"),
        *(rows(mapping.where(~F.lower(strip(F.col(c))).isin("", "nan")), row, p, strip(F.col(c)), "iri") for c, p in (("uri1", V.matches[0]), ("uri2", V.matches[1]), ("uri3", V.matches[2]))),
    ]
    return G.union(*parts)


T = full(f"""with half as (select *, lower(trim(string_split(title, ' / ')[1])) as hz, lower(trim(string_split(title, ' / ')[2])) as pr, regexp_matches(model_id, '[13579]$') as direct from models),
lab as (select label_norm, min(iri) as iri from ontology_index group by 1),
triples as (
select iri as s, 'rdf:type' as p, 'skos:Concept' as o from ontology_index
union all select iri, 'skos:prefLabel', label from ontology_index
union all select iri, 'skos:inScheme', 'https://sem.example/scheme/' || space from ontology_index
union all select i.iri, 'skos:altLabel', y.syn_norm from ontology_synonym y join ontology_index i on y.canonical = i.label
union all select 'model:' || model_id, 'rdf:type', 'meta:Model' from models
union all select 'model:' || model_id, 'schema:identifier', model_id from models
union all select 'model:' || model_id, 'schema:name', title from models where title is not null
union all select 'model:' || model_id, 'meta:hasScope', 'scope:' || model_id from half where not direct
union all select case when direct then 'model:' else 'scope:' end || model_id, 'meta:hazard', iri from half join lab on hz = label_norm where contains(title, ' / ')
union all select case when direct then 'model:' else 'scope:' end || model_id, 'meta:product', iri from half join lab on pr = label_norm where contains(title, ' / ')
union all select 'model:' || model_id, 'meta:hasParameter', 'param:' || param_key from model_parameter
union all select 'param:' || param_key, 'meta:paramId', id from model_parameter where id is not null
union all select 'param:' || param_key, 'schema:name', name from model_parameter where name is not null
union all select 'param:' || param_key, 'meta:unit', unittext from model_parameter where unittext is not null
union all select 'param:' || param_key, 'meta:classification', classification from model_parameter where classification is not null
union all select 'map:' || row_id, 'skos:exactMatch', {sql_strip('uri1')} from master_mapping where lower({sql_strip('uri1')}) not in ('', 'nan')
union all select 'map:' || row_id, 'skos:closeMatch', {sql_strip('uri2')} from master_mapping where lower({sql_strip('uri2')}) not in ('', 'nan')
union all select 'map:' || row_id, 'skos:broadMatch', {sql_strip('uri3')} from master_mapping where lower({sql_strip('uri3')}) not in ('', 'nan')),
link as (select m.s as model, t.p, t.o from triples m join triples t on t.s = m.o where m.p = 'meta:hasScope' and t.p in ('meta:hazard', 'meta:product')
  union all select t.s, t.p, t.o from triples t join triples m on m.s = t.s and m.p = 'rdf:type' and m.o = 'meta:Model' where t.p in ('meta:hazard', 'meta:product')),
pair as (select a.model, a.o as product, b.o as hazard from link a join link b on a.model = b.model where a.p = 'meta:product' and b.p = 'meta:hazard')
""")


@query(T + full("select p, count(*) as n, count(distinct s) as subjects from triples group by p"))
def triples_by_predicate(load):
    """M1. The triples of the tables, counted by predicate."""
    return triples(load).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


@query(T + full(rf""", q as (select distinct term, lower({sql_strip("term")}) as q from matching_table_for_reconciliation where {sql_strip("term")} <> ''),
l as (select distinct s, o as label from triples where p in ('skos:prefLabel', 'skos:altLabel') and s in (select s from triples where p = 'rdf:type' and o = 'skos:Concept')),
sch as (select s, min(o) as scheme from triples where p = 'skos:inScheme' group by s)
select term, s, label, scheme, cast(row_number() over (partition by term order by label, s) as integer) as rank from q join l on contains(lower(label), q) left join sch using (s) qualify rank <= 10"""))
def q1_concept_search(load):
    """Q1/Q4. Concepts whose preferred or alternative label holds a term of the matching table, ten per term."""
    return G.search_labels(triples(load), load("matching_table_for_reconciliation").select("term"), [V.concept], [V.pref_label, V.alt_label], {"scheme": V.in_scheme}, 10)


@query(T + full(r"""select s, min(o) as label, count(*) as n from triples where p in ('skos:prefLabel', 'skos:altLabel') and regexp_matches(lower(o), '(powder|vibrio)') group by s"""))
def q3_regex_sample(load):
    """Q3. Labels by regular expression and language, one sample label per concept."""
    t = triples(load)
    hits = G.pattern(t, "?s", [V.pref_label, V.alt_label], "?label", where=G.lang_matches(F.col("o_lang"), "en") & F.col("o").rlike("(?i)(powder|vibrio)"))
    return hits.groupBy("s").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))


@query(T + full("""select a.s, a.o as scheme, b.o as label from triples a join triples b on a.s = b.s where a.p = 'skos:inScheme' and b.p = 'skos:prefLabel' and (starts_with(a.o, 'https://sem.example/scheme/pro') or starts_with(a.o, 'https://sem.example/scheme/ind'))"""))
def q5_scheme_concepts(load):
    return G.concepts_in_schemes(triples(load), ["https://sem.example/scheme/pro", "https://sem.example/scheme/ind"]).select("s", "scheme", "label")


@query(T + full("""select distinct product, a.o as product_label, hazard, b.o as hazard_label from pair join (select s, min(o) as o from triples where p = 'skos:prefLabel' group by s) a on a.s = product join (select s, min(o) as o from triples where p = 'skos:prefLabel' group by s) b on b.s = hazard"""))
def q6_catalogue(load):
    return G.catalogue(triples(load), V)


@query(T + full("select product, hazard, min(model) as model from pair join triples i on i.s = model and i.p = 'schema:identifier' group by 1, 2"))
def q8_find_models(load):
    return G.find_models(triples(load), V)


@query(T + full("select a.s as model, a.o as param, n.o as name, u.o as unit from triples a join triples n on n.s = a.o and n.p = 'schema:name' join triples u on u.s = a.o and u.p = 'meta:unit' where a.p = 'meta:hasParameter'"))
def q9_inputs(load):
    """Q9. Names and units of the parameters of every model: three patterns."""
    t = triples(load)
    return G.bgp(G.path(t, "?model", V.has_parameter, "?param"), G.pattern(t, "?param", V.name, "?name"), G.pattern(t, "?param", V.unit, "?unit")).select("model", "param", "name", "unit")


@query("""select param_key, coalesce(r.symbol, case when regexp_matches(unittext, '[/#]') then nullif(string_split(string_split(unittext, '/')[-1], '#')[-1], '') end, 'unknown unit') as unit_name from model_parameter m left join (select iri, min(symbol) as symbol from unit_reference group by 1) r on m.unittext = r.iri""")
def q10_unit_symbols(load):
    units = load("model_parameter").select("param_key", F.col("unittext").alias("iri"))
    return G.unit_symbols(units, load("unit_reference").select("iri", "symbol")).select("param_key", "unit_name")


@query(T + full("select min(s) as model from triples where p = 'meta:hasParameter'"))
def q12_main_model(load):
    """Q12. No composite model here, so the first model with parameters."""
    return G.main_model(triples(load), V)


@query(T + full("""select m.s as model, coalesce(n.o, i.o, m.s) as name from (select distinct s from triples where p = 'meta:hasParameter') m left join triples n on n.s = m.s and n.p = 'schema:name' left join triples i on i.s = m.s and i.p = 'schema:identifier'"""))
def q13_models_named(load):
    t = triples(load)
    models = G.path(t, "?model", V.has_parameter, "?x").select("model").distinct()
    full = G.optional(models, G.pattern(t, "?model", V.name, "?n"), G.path(t, "?model", V.identifier, "?i"))
    return full.select("model", F.coalesce("n", "i", "model").alias("name"))


@query(T + full(""", n as (select s as model, o as name from triples where p = 'schema:name' and s in (select s from triples where o = 'meta:Model')),
k as (select * from n where not exists (select 1 from n b where b.name <> n.name and b.name <> '' and contains(n.name, b.name)))
select * from k union all select * from n where (select count(*) from k) = 0"""))
def q14_without_containers(load):
    t = triples(load)
    models = G.bgp(G.pattern(t, "?model", V.type, V.model), G.pattern(t, "?model", V.name, "?name"))
    return G.without_containers(models).select("model", "name")


@query(T + full(""", f as (select a.s as model, coalesce(i.o, n.o) as param_id, n.o as name, u.o as unit, case when regexp_matches(c.o, ':.*[^0-9]17481$') then 'INPUT' else upper(c.o) end as role
  from triples a left join triples i on i.s = a.o and i.p = 'meta:paramId' left join triples n on n.s = a.o and n.p = 'schema:name' left join triples u on u.s = a.o and u.p = 'meta:unit' left join triples c on c.s = a.o and c.p = 'meta:classification' where a.p = 'meta:hasParameter')
select model, param_id, min(name) as name, min(unit) as unit, coalesce(array_to_string(list_sort(list_distinct(list(role) filter (role is not null))), ','), '') as roles from f where param_id is not null and not regexp_matches(param_id, '[0-9]$') group by 1, 2"""))
def q15_parameters(load):
    """Q15/Q18."""
    return G.parameters(triples(load), CODES, V).withColumn("roles", F.array_join("roles", ","))


@query(T + full("select distinct case p when 'meta:hazard' then 'hazard' else 'product' end as kind, o as uri from triples where p in ('meta:hazard', 'meta:product')"))
def q16_scope(load):
    return G.direct_scope(triples(load), V)


_IO = """, io as (select distinct a.s as model, lower(n.o) as name, upper(c.o) as class from triples a join triples n on n.s = a.o and n.p = 'schema:name' join triples c on c.s = a.o and c.p = 'meta:classification' where a.p = 'meta:hasParameter'),
e as (select a.model as source, b.model as target, a.name from io a join io b on a.name = b.name and a.class = 'OUTPUT' and b.class = 'INPUT' and a.model <> b.model)
"""


@query(T + full(_IO + "select distinct source, target, name from e"))
def q17_connections(load):
    """Q17."""
    return G.connections(triples(load), V)


@query(T + full(""", u as (select distinct uri from suggestion where uri is not null)
select distinct uri, uri as concept from u join triples t on t.s = uri and t.p = 'rdf:type' and t.o = 'skos:Concept'
union select uri, s from u join triples t on t.o = uri and t.p in ('skos:exactMatch', 'skos:closeMatch', 'skos:narrowMatch')"""))
def q20_match_by_uri(load):
    return G.match_by_uri(triples(load), load("suggestion").where("uri is not null").select("uri").distinct())


@query(T + full(r""", v as (select distinct term as text from master_mapping)
select distinct text, s as concept from v join triples on p in ('skos:prefLabel', 'skos:altLabel') and lower(o) = lower(text)"""))
def q21_match_by_label(load):
    return G.match_by_label(triples(load), load("master_mapping").select(F.col("term").alias("text")))


@query(T + full(""", n as (select s, arg_min(o, (case p when 'skos:prefLabel' then 0 else 1 end, o)) as name from triples where p in ('skos:prefLabel', 'rdfs:label') group by s),
a as (select s, list_sort(list_distinct(list(o))) as alts from triples where p = 'skos:altLabel' group by s),
t as (select n.s, name, list_slice(list_filter(coalesce(alts, []), lambda x: x <> name), 1, 2) as two from n left join a using (s))
select s, case when len(two) > 0 then name || ' (' || array_to_string(two, '; ') || ')' else name end as display from t"""))
def q23_display(load):
    return G.display_structs(triples(load))


@query(T + full("""select s, p, o from (select distinct s, p, o from triples) t where not (s in (select s from triples where p = 'schema:identifier' and o like '%1') and p = 'schema:name')"""))
def u5_remove(load):
    """U2/U5. The set of triples without the names of some models (a pattern with any object)."""
    t = triples(load)
    gone = G.path(t, "?s", V.identifier, "?o").where(F.col("o").endswith("1")).select("s", F.lit(V.name).alias("p"), F.lit(None).cast("string").alias("o"))
    return G.removed(G.merged(t), gone, bound=("sp",)).select("s", "p", "o")


@query(T + full("select s from triples where p = 'skos:altLabel' except select s from triples where p = 'skos:inScheme' and o = 'https://sem.example/scheme/class'"))
def u4_difference(load):
    """U3/U4. Subjects with alternative labels that aren't in a scheme."""
    t = triples(load)
    a, b = G.pattern(t, "?s", V.alt_label, "?x").select("s"), G.pattern(t, "?s", V.in_scheme, "https://sem.example/scheme/class").select("s")
    return a.distinct().join(b, "s", "left_anti")


@query("""with recursive e as (select n_nationkey as source, n_regionkey + 100 as target from nation union all select r_regionkey + 100, 200 from region union all select 200, 201),
nodes as (select source as node from e union select target from e),
walk as (select node, 0 as level from nodes union select e.target, level + 1 from walk join e on e.source = walk.node)
select node, max(level) as level from walk group by node""")
def j11_topological(load):
    """J11. Levels of the graph nation, region, world, all."""
    n, r = load("nation"), load("region")
    shared_folder(n.sparkSession)
    edges = n.select(F.col("n_nationkey").alias("source"), (F.col("n_regionkey") + 100).alias("target")).unionByName(r.select((F.col("r_regionkey") + 100).alias("source"), F.lit(200).alias("target")))
    edges = edges.unionByName(r.limit(1).select(F.lit(200).alias("source"), F.lit(201).alias("target")))
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return G.topological_levels(edges, nodes)


@query()
def j11_cascade(load):
    """J11 over Q17: the order in which models feed each other; models on cycles come last."""
    t = triples(load)
    shared_folder(t.sparkSession)
    return G.topological_levels(G.connections(t, V).select("source", "target"), G.pattern(t, "?node", V.type, V.model))


def regions(load) -> DataFrame:
    """Triples of regions: nations as concepts with a level, a label and a geometry of four corners, some without."""
    n = load("nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") * 3 - 36).alias("x"), (F.col("n_regionkey") * 10).alias("y"))
    region, shape = F.concat(F.lit("https://sem.example/region/"), "n_nationkey"), F.concat(F.lit("https://sem.example/shape/"), "n_nationkey")
    at = lambda dx, dy: F.concat((F.col("x") + dx).cast("string"), F.lit(" "), (F.col("y") + dy).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(0, 0), at(2, 0), at(2, 2), at(0, 2), at(0, 0)), F.lit("))"))
    row = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))
    known = F.array(row(region, V.type, F.lit(V.concept), "iri"), row(region, V.level, F.col("n_regionkey"), "literal"), row(region, V.pref_label, F.col("n_name"), "literal"))
    shaped = F.array(row(region, V.has_geometry, shape, "iri"), row(shape, V.as_wkt, wkt, "literal"))
    return n.select(F.inline(F.concat(known, F.when(F.col("n_nationkey") % 5 != 4, shaped).otherwise(F.slice(shaped, 1, 0)))))


@query("""select 'https://sem.example/region/' || n_nationkey as region, cast(n_regionkey as varchar) as level, n_name as label,
  'POLYGON ((' || x || ' ' || y || ', ' || x + 2 || ' ' || y || ', ' || x + 2 || ' ' || y + 2 || ', ' || x || ' ' || y + 2 || ', ' || x || ' ' || y || '))' as wkt
from (select *, n_nationkey * 3 - 36 as x, n_regionkey * 10 as y from nation) where n_regionkey in (1, 3) and n_nationkey % 5 <> 4""")
def q7_regions(load):
    """Q7. Regions of two levels that have a geometry."""
    return G.regions(regions(load), ["1", "3"], V)


@query("""select 'POLYGON ((' || x || ' ' || y || ', ' || x + 2 || ' ' || y || ', ' || x + 2 || ' ' || y + 2 || ', ' || x || ' ' || y + 2 || ', ' || x || ' ' || y || '))' as wkt
from (select *, n_nationkey * 3 - 36 as x, n_regionkey * 10 as y from nation) where n_nationkey = 7""")
def q11_region_shape(load):
    """Q11. The geometry of one region."""
    return G.region_shape(regions(load), "https://sem.example/region/7", V)


@query(T + full("""select distinct case t.p when 'meta:hazard' then 'hazard' else 'product' end as kind, t.o as label, 'node:' || md5(t.o) || case when starts_with(t.o, 'https://vocab') then '' else ' ' || t.o end as uris
from triples t where t.p in ('meta:hazard', 'meta:product')"""))
def q19_scope_candidates(load):
    """Q19. Hazards and products as nodes with a label, and (outside one vocabulary) a name that is an iri."""
    t = triples(load)
    scope = t.where(F.col("p").isin(V.hazard, V.product))
    node = F.concat(F.lit("node:"), F.md5("o"))
    none = F.lit(None).cast("string")
    moved = scope.select("s", "p", node.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_lang"))
    named = scope.select(node.alias("s"), F.explode(F.array(F.struct(F.lit(V.label).alias("p"), F.col("o"), F.lit("literal").alias("o_kind")), F.struct(F.lit(V.name).alias("p"), F.col("o"), F.lit("iri").alias("o_kind")))).alias("t"))
    named = named.select("s", "t.*", none.alias("o_lang")).where((F.col("p") == V.label) | ~F.col("o").startswith("https://vocab"))
    out = G.scope_candidates(G.union(moved, named), V)
    # The node first, then its name.
    return out.select("kind", "label", F.array_join(F.array_sort("uris", lambda a, b: F.when(a == b, 0).when(a.startswith("node:"), -1).otherwise(1)), " ").alias("uris"))


@query(T + full("""select distinct a.o as uri, a.s as source, string_split(a.s, '/')[-1] as variable, '' as pref, '' as alt, string_split(a.s, '/')[-1] as id from triples a where a.p = 'skos:exactMatch' and a.o in (select uri1 from master_mapping union all select uri2 from master_mapping)"""))
def q22_variable_candidates(load):
    """Q22. What is an exact match of any mapped uri, with its variable's name."""
    return G.variable_candidates(triples(load), load("master_mapping").select(F.explode(F.array("uri1", "uri2")).alias("uri")), V)


@query(T + full(rf"""select distinct q.term, t.s, t.o as label, cast(dense_rank() over (partition by q.term order by t.o, t.s) as integer) as rank
from (select distinct unit_name as term, lower({sql_strip("unit_name")}) as q from unit_reference) q join triples t on t.p = 'skos:prefLabel' and contains(lower(t.o), q.q) qualify rank <= 20"""))
def q2_unit_search(load):
    """Q2. English labels that hold the name of a unit."""
    return G.search_labels(triples(load), load("unit_reference").select(F.col("unit_name").alias("term")), [V.concept], [V.pref_label], {}, 20, lang="en")


QUERIES, SQL = query.queries, query.sql
