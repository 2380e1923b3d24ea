"""Queries of reconciliation, matching and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions import text as T
from semloom.operators import cascade, inference, reconcile
from semloom.plans.query import WORD, Queries, sql_keywords, sql_levenshtein, sql_normalize, sql_sanitize, sql_slug, sql_strip

query = Queries()
_LEV = sql_levenshtein


def _names(load):
    return load("part").select("p_name").distinct()


@query(f"""select a.p_name as term, b.p_name as candidate, {_LEV("a.p_name", "b.p_name")} as score
from (select distinct p_name from part) a join (select distinct p_name from part) b
  on a.p_name <> b.p_name and abs(length(a.p_name) - length(b.p_name)) <= floor(greatest(length(a.p_name), length(b.p_name)) * 0.3e0 + 1e-9)
where {_LEV("a.p_name", "b.p_name")} >= 0.7""")
def x1_levenshtein_pairs(load):
    """X1 with the bounded form: all pairs of different part names of similarity 0.7 or more, joined on rare letters they must share."""
    a, b = _names(load).withColumnRenamed("p_name", "term"), _names(load).withColumnRenamed("p_name", "candidate")
    return inference.edit_pairs(a, "term", b, "candidate", 0.7).where("term <> candidate")


_TOP = f"""
with t as (select term_id, {sql_strip("term")} as term from matching_table_for_reconciliation where coalesce(uri, '') in ('', 'No Match') and {sql_strip("term")} <> ''),
s as (select s.term_id, s.suggestion_id, s.label, s.uri, s.provider_ord, s.api_rank, s.score as api_score, {_LEV("t.term", "s.label")} as lev
  from suggestion s join t on s.term_id = t.term_id
  where s.label is not null and s.uri is not null)
"""


def _scored(load):
    terms = load("matching_table_for_reconciliation").where(reconcile.is_pending(F.col("uri"))).withColumn("term", T.strip(F.col("term")))
    return reconcile.scored(terms, reconcile.well_formed(load("suggestion")))


@query(_TOP + """select term_id, suggestion_id, lev as score, cast(row_number() over (partition by term_id order by lev desc, provider_ord, api_rank, suggestion_id) as integer) as rank
from s qualify rank <= 10""")
def t1_rank_levenshtein(load):
    """T1 by edit similarity: the ten best suggestions of every pending term."""
    top = reconcile.ranked(_scored(load), F.col("levenshtein_score"), 10)
    return top.select("term_id", "suggestion_id", F.col("levenshtein_score").alias("score"), "rank")


@query("""select term_id, suggestion_id, cast(row_number() over (partition by term_id order by case when score is null or isnan(score) then -1.0 else score end desc, provider_ord, api_rank, suggestion_id) as integer) as rank
from suggestion where label is not null and uri is not null qualify rank <= 10""")
def t1_rank_api(load):
    """T1 by the provider's score; without a number it counts as -1."""
    return reconcile.ranked(reconcile.well_formed(load("suggestion")), F.col("score"), 10).select("term_id", "suggestion_id", "rank")


@query(_TOP + """select term_id, suggestion_id, lev as score, cast(row_number() over (partition by term_id order by lev desc, provider_ord, api_rank, suggestion_id) as integer) as rank
from s where lev > 0.6 qualify rank <= 5""")
def t2_local_threshold(load):
    """T2. Above 0.6, then the five best."""
    return reconcile.local_matches(_scored(load), 0.6, 5).select("term_id", "suggestion_id", F.col("levenshtein_score").alias("score"), "rank")


@query(_TOP + """, b as (select term_id, arg_max(struct_pack(u := uri, l := label), (lev, -provider_ord, -api_rank, -suggestion_id)) as f, max(lev) as score from s group by term_id)
select m.term_id, case when coalesce(m.uri, '') not in ('', 'No Match') then m.uri when b.score >= 0.7 then b.f.u else 'No Match' end as uri,
  case when coalesce(m.uri, '') not in ('', 'No Match') then coalesce(m.provider_term, '') when b.score >= 0.7 then b.f.l else '' end as provider_term,
  case when (coalesce(m.uri, '') not in ('', 'No Match') or b.score >= 0.7 and b.f.u not in ('', 'No Match')) and coalesce(m.match_type, '') = '' then 'skos:exactMatch' else coalesce(m.match_type, '') end as match_type
from matching_table_for_reconciliation m left join b using (term_id)""")
def t3_best_match(load):
    """T3/T4. Every term with its best match or 'No Match' (the flagship)."""
    out = reconcile.best_match(load("matching_table_for_reconciliation"), load("suggestion"))
    return out.select("term_id", "uri", "provider_term", "match_type")


@query("""select term_id, term from matching_table_for_reconciliation where coalesce(uri, '') in ('', 'No Match')""")
def f1_pending(load):
    return load("matching_table_for_reconciliation").where(reconcile.is_pending(F.col("uri"))).select("term_id", "term")


@query("""select term_id, coalesce(term, '') as term, coalesce(uri, '') as uri, coalesce(rdf_role, '') as rdf_role, coalesce(match_type, '') as match_type,
  coalesce(source_provider, '') as source_provider, coalesce(provider_term, '') as provider_term, coalesce(provider_description, '') as provider_description,
  coalesce(confirmed_display_string, '') as confirmed_display_string from matching_table_for_reconciliation""")
def f2_prepared(load):
    return reconcile.prepared(load("matching_table_for_reconciliation")).select("term_id", *reconcile.REQUIRED, *reconcile.ADDED)


@query("select distinct term from matching_table_for_reconciliation")
def f3_distinct_terms(load):
    return load("matching_table_for_reconciliation").select("term").distinct()


@query("select term_id from matching_table_for_reconciliation m where exists (select 1 from suggestion s where s.term_id = m.term_id and s.provider = 'olx')")
def f4_with_suggestions(load):
    return reconcile.with_suggestions(load("matching_table_for_reconciliation"), load("suggestion"), "olx").select("term_id")


@query("select term_id from matching_table_for_reconciliation where coalesce(uri, '') in ('', 'No Match') or coalesce(match_type, '') = ''")
def f5_unreconciled(load):
    return load("matching_table_for_reconciliation").where(reconcile.is_unreconciled(F.col("uri"), F.col("match_type"))).select("term_id")


@query("select suggestion_id from suggestion where upper(coalesce(nullif(ontology, ''), source_provider)) in ('FPX', 'HZX')")
def f6_ontology_filter(load):
    return reconcile.in_ontologies(load("suggestion"), ["fpx", "Hzx"]).select("suggestion_id")


@query("select suggestion_id from suggestion where label is not null and uri is not null")
def f7_well_formed(load):
    return reconcile.well_formed(load("suggestion")).select("suggestion_id")


@query("""select term, case when uri = 'No Match' then '' else uri end as uri, rdf_role, match_type, source_provider, provider_term, provider_description from matching_table_for_reconciliation""")
def f8_export(load):
    return reconcile.export(load("matching_table_for_reconciliation"))


@query("select term_id, term from matching_table_for_reconciliation order by term_id limit 25 offset 50")
def t5_page(load):
    """T5. The third page of 25 terms (the limit is the feature)."""
    return reconcile.page(load("matching_table_for_reconciliation"), ["term_id"], 3, 25).select("term_id", "term")


_TOKENS = "list_filter(string_split_regex({c}, '[^a-z0-9]+'), lambda x: x <> '' and x not in ('sp','spp','cf','strain','subsp','serovar','serotype'))"


@query(f"""with d as (select label, {_TOKENS.format(c=sql_normalize("label"))} as t from (select distinct label from suggestion))
select label, array_to_string(t, ' ') as tokens, cast(len(t) as integer) as n from d where label is not null""")
def x6_tokens(load):
    """X5/X6. Normalised tokens of every distinct label."""
    d = load("suggestion").select("label").distinct().where("label is not null").withColumn("q", T.normalize(F.col("label")))
    t = T.tokens(F.col("q"))
    return d.select("label", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"select distinct term, {sql_normalize('term')} as normal from matching_table_for_reconciliation")
def x5_normalize(load):
    """X5 with compatibility forms: every distinct term."""
    return load("matching_table_for_reconciliation").select("term").distinct().withColumn("normal", T.normalize(F.col("term")))


@query("""with o as (select concept_id, label_norm, list_distinct(list_filter(string_split_regex(label_norm, '[^a-z0-9]+'), lambda x: x <> '' and x not in ('sp','spp','cf','strain','subsp','serovar','serotype'))) as t from ontology_index),
p as (select distinct a.concept_id as a, b.concept_id as b, a.t as ta, b.t as tb from (select *, unnest(t) as w from o) a join (select *, unnest(t) as w from o) b on a.w = b.w and a.concept_id < b.concept_id)
select a, b, cast(len(list_intersect(ta, tb)) as double) / len(list_distinct(list_concat(ta, tb))) as score from p
where cast(len(list_intersect(ta, tb)) as double) / len(list_distinct(list_concat(ta, tb))) >= 0.5""")
def x7_jaccard_pairs(load):
    """X7. Pairs of entries of the reference list with half of their words in common, joined on shared words."""
    o = load("ontology_index").select("concept_id", F.array_distinct(T.tokens(F.col("label_norm"))).alias("t"))
    a = o.select(F.col("concept_id").alias("a"), F.col("t").alias("ta"), F.explode("t").alias("w"))
    b = o.select(F.col("concept_id").alias("b"), F.col("t").alias("tb"), F.explode("t").alias("w"))
    pairs = a.join(b, "w").where("a < b").select("a", "b", "ta", "tb").distinct()
    return pairs.withColumn("score", T.jaccard(F.col("ta"), F.col("tb"))).where("score >= 0.5").select("a", "b", "score")


@query(f"""with k as (select row_id, {sql_keywords("term")} as t, {sql_keywords("altlabels")} as u from master_mapping where term is not null and altlabels is not null)
select row_id, round(coalesce((select sum(case when x = y then 1.0e0 when contains(y, x) or contains(x, y) then 0.8e0 else 0e0 end) from (select unnest(t) as x), (select unnest(u) as y)), 0e0), 6) as score from k""")
def x8_keyword_overlap(load):
    """X8. Keyword overlap of each mapping's term with its alternative labels."""
    m = load("master_mapping").where("term is not null and altlabels is not null")
    return m.select("row_id", F.round(T.keyword_overlap(T.keyword_tokens(F.col("term")), T.keyword_tokens(F.col("altlabels"))), 6).alias("score"))


@query(f"""select label, {sql_sanitize("label")} as iri_part, {sql_slug("label")} as slug, substr(md5(label), 1, 8) as hash, regexp_replace(label, '[^{WORD}\\-]', '_', 'g') as file_name from (select distinct label from suggestion where label is not null)""")
def x12_iri_parts(load):
    """X12-X15. Every distinct label as part of an IRI, as slug, short hash and file name."""
    d = load("suggestion").select("label").distinct().where("label is not null")
    c = F.col("label")
    return d.select("label", T.sanitize_iri(c).alias("iri_part"), T.slugify(c).alias("slug"), T.hash_id(c).alias("hash"), T.cache_name(c).alias("file_name"))


@query("""select row_id, case when trim(coalesce(altlabels, ''), ' ') <> '' then term || ' (' || altlabels || ')' else term end as display from master_mapping""")
def x16_display_label(load):
    return load("master_mapping").select("row_id", T.display_label(F.col("term"), F.col("altlabels")).alias("display"))


@query("""select suggestion_id, concat_ws(' ', coalesce(label, 'N/A'), case when coalesce(source_provider, '') <> '' then '[' || source_provider || ']' end, case when score is not null and not isnan(score) then '[Lev: ' || printf('%.2f', score) || ']' end,
  case when coalesce(description, '') <> '' then '(' || case when length(description) > 100 then substr(description, 1, 100) || '...' else description end || ')' end, '<' || coalesce(nullif(uri, ''), 'No URI') || '>') as display
from suggestion""")
def x17_suggestion_display(load):
    """X17. Every suggestion as one line."""
    s = load("suggestion")
    score = F.when(~F.isnan("score"), F.col("score"))
    return s.select("suggestion_id", T.suggestion_display(F.col("label"), F.col("source_provider"), score, F.col("description"), F.col("uri")).alias("display"))


@query("""select suggestion_id, string_split(string_split(uri, '/')[-1], '#')[-1] as local_name, case when contains(uri, '/') then regexp_replace(uri, '/[^/]*$', '') else '' end as namespace, regexp_replace(coalesce(id, ''), '\\d+$', '') as stem
from suggestion where uri is not null and uri <> ''""")
def x18_uri_parts(load):
    """X18, X20, X22. Local name and namespace of every uri; the id without its digits."""
    s = load("suggestion").where("uri is not null and uri <> ''")
    return s.select("suggestion_id", T.local_name(F.col("uri")).alias("local_name"), T.uri_namespace(F.col("uri")).alias("namespace"), T.strip_digits(F.coalesce("id", F.lit(""))).alias("stem"))


@query(f"""select row_id, cast(unnest(generate_series(1, len(v))) as integer) as pos, unnest(v) as part from (
  select row_id, list_filter(list_transform(string_split(altlabels, ','), lambda x: {sql_strip('x')}), lambda x: x <> '') as v from master_mapping where altlabels is not null)""")
def x21_comma_list(load):
    m = load("master_mapping").select("row_id", F.posexplode(T.comma_list(F.col("altlabels"))).alias("pos", "part"))
    return m.select("row_id", (F.col("pos") + 1).alias("pos"), "part")


@query("""select suggestion_id, case when coalesce(id, '') = '' then null when db = 'taxonomy' then 'https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=' || id
  when db = 'sra' then 'https://www.ncbi.nlm.nih.gov/sra?term=' || id when db = 'pubmed' then 'https://pubmed.ncbi.nlm.nih.gov/' || id || '/' else 'https://www.ncbi.nlm.nih.gov/' || db || '/' || id end as page
from (select suggestion_id, id, list_extract(['taxonomy', 'gene', 'sra', 'pubmed'], 1 + api_rank % 4) as db from suggestion)""")
def x23_record_page(load):
    s = load("suggestion").withColumn("db", F.element_at(F.array(*map(F.lit, ("taxonomy", "gene", "sra", "pubmed"))), (F.col("api_rank") % 4 + 1).cast("int")))
    return s.select("suggestion_id", T.ncbi_uri(F.col("db"), F.col("id")).alias("page"))


@query(f"""select param_key, 'https://sem.example/' || {sql_sanitize("model_id")} || '/parameter/' || coalesce(nullif({sql_sanitize("id")}, ''), substr(md5(coalesce(name, '')), 1, 8)) as iri from model_parameter""")
def x24_parameter_iri(load):
    """X24. The IRI of every parameter: from its id, else from a hash."""
    p = load("model_parameter")
    return p.select("param_key", T.mint("https://sem.example/", F.col("model_id"), "parameter", [F.col("id")], F.coalesce("name", F.lit(""))).alias("iri"))


@query("""select suggestion_id, case when starts_with(i, 'agr:') and contains(i, 'FPX_') then replace(i, 'agr:', 'https://vocab.agrisem.example/class/') else i end as iri from (select suggestion_id, 'agr:' || id as i from suggestion where id is not null)""")
def x26_expand(load):
    s = load("suggestion").where("id is not null").withColumn("i", F.concat(F.lit("agr:"), "id"))
    return s.select("suggestion_id", T.expand_prefixed(F.col("i"), "agr", "https://vocab.agrisem.example/class/", "FPX_").alias("iri"))


@query()
def x4_sequence_ratio(load):
    """X4. Ratio of every model's parameter name with its id (no SQL function for it)."""
    p = load("model_parameter").where("name is not null and id is not null")
    return p.select("param_key", F.round(T.sequence_ratio(F.lower("name"), F.lower("id")), 9).alias("ratio"))


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
c as (select label, list_transform(generate_series(1, len(any_value(v))), lambda i: 0.0) as z, count(*) as n from e group by label),
k as (select label, min(vec_id) as vec_id from e group by label)
select a.vec_id, a.label, round(list_cosine_similarity(a.v, b.v), 6) as score from e a join k on a.label = k.label join e b on b.vec_id = k.vec_id""")
def x2_cosine(load):
    """X2. Cosine of every vector with the first of its label."""
    e = load("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return e.join(first, "label").select("vec_id", "label", F.round(T.cosine(F.col("embedding"), F.col("b")), 6).alias("score"))


@query(f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), n as (select count(*) as n from e),
s as (select s.suggestion_id, {_LEV(sql_strip("m.term"), "s.label")} as lev, s.suggestion_id % n as a, m.term_id % n as b, (s.suggestion_id + 7) % n as c from suggestion s join matching_table_for_reconciliation m using (term_id), n where {sql_strip("m.term")} <> '' and s.label is not null)
select suggestion_id, round(list_cosine_similarity(x.v, y.v) * 0.5 + list_cosine_similarity(z.v, y.v) * 0.2 + lev * 0.3, 6) as score from s join e x on x.vec_id = a join e y on y.vec_id = b join e z on z.vec_id = c""")
def x2_hybrid(load):
    """X2. Weighted sum of the cosine of label and description, of the label alone (vectors of the table stand for both and for the term), and the edit similarity."""
    s = reconcile.scored(load("matching_table_for_reconciliation"), load("suggestion").where("label is not null"))
    e = load("embeddings").select("vec_id", "embedding")
    n = e.agg(F.count(F.lit(1))).scalar()
    placed = s.select("suggestion_id", "levenshtein_score", (F.col("suggestion_id") % n).alias("a"), (F.col("term_id") % n).alias("b"), ((F.col("suggestion_id") + 7) % n).alias("c"))
    for k in "abc":
        placed = placed.join(e.select(F.col("vec_id").alias(k), F.col("embedding").alias(f"v{k}")), k)
    return placed.select("suggestion_id", F.round(T.hybrid_score(T.cosine(F.col("va"), F.col("vb")), T.cosine(F.col("vc"), F.col("vb")), F.col("levenshtein_score")), 6).alias("score"))


_MT1 = f"""
with q as (select distinct name as text, 'hazard' as field, {sql_normalize('name')} as q from model_parameter),
qt as (select *, {_TOKENS.format(c="q")} as t from q where q <> ''),
o as (select space, label_norm as label, arg_max(iri, ord) as iri, min(ord) as ord, case when space = 'class' then 0 else 1 end as so from ontology_index where space in ('class', 'individual') group by 1, 2),
ot as (select *, {_TOKENS.format(c="label")} as t from o),
syn as (select syn_norm, lower(arg_max(canonical, ord)) as label from ontology_synonym group by 1),
h as (
  select text, field, iri, o.label, 1 as pass, 1.0 as score, so, ord from qt join o on q = o.label
  union all select text, field, iri, o.label, 2, 1.0, so, ord from qt join syn on q = syn_norm join o on o.label = syn.label
  union all select text, field, iri, ot.label, 3, 1.0, so, ord from qt join ot on list_sort(list_distinct(qt.t)) = list_sort(list_distinct(ot.t)) and len(qt.t) > 0
  union all select text, field, iri, ot.label, case when length(q) >= 6 and (starts_with(ot.label, q) or starts_with(q, ot.label)) then 4 else 5 end,
    case when length(q) >= 6 and (starts_with(ot.label, q) or starts_with(q, ot.label)) then 1.0 else cast(len(list_intersect(qt.t, ot.t)) as double) / len(list_distinct(list_concat(qt.t, ot.t))) end, so, ord
    from qt join ot on len(list_intersect(qt.t, ot.t)) > 0 and cast(len(list_intersect(qt.t, ot.t)) as double) / len(list_distinct(list_concat(qt.t, ot.t))) >= 0.8
)
select q.text, q.field, h.iri, h.label, cast(h.pass as integer) as pass, round(h.score, 9) as score from q left join (select * from h qualify row_number() over (partition by text, field order by pass, score desc, so, ord, label) = 1) h using (text, field) where q.q <> ''
"""


def _values(load, field: str):
    return load("model_parameter").select(F.col("name").alias("text"), F.lit(field).alias("field"))


@query(_MT1)
def mt1_cascade(load):
    """MT1, passes 1 to 5, for every parameter name."""
    out = cascade.match_ontology(_values(load, "hazard"), load("ontology_index"), load("ontology_synonym"), near=False)
    return out.withColumns({"pass": F.col("pass").cast("int"), "score": F.round("score", 9)})


@query()
def mt1_cascade_near(load):
    """MT1 with pass 6 (near misses by matching blocks), for every parameter name."""
    return cascade.match_ontology(_values(load, "hazard"), load("ontology_index"), load("ontology_synonym"))


@query(f"""with q as (select distinct name as text, {sql_normalize('name')} as q from model_parameter), o as (select space, label_norm as label, arg_max(iri, ord) as iri, min(ord) as ord, case when space = 'class' then 1 else 0 end as so from ontology_index where space in ('class', 'individual') group by 1, 2),
syn as (select syn_norm, lower(arg_max(canonical, ord)) as label from ontology_synonym group by 1),
h as (select text, iri, o.label, 1 as pass, so, ord from q join o on q = o.label union all select text, iri, o.label, 2, so, ord from q join syn on q = syn_norm join o on o.label = syn.label
  union all select text, iri, label, 3, so, ord from q join o on (contains(label, q) and length(q) >= 3 or contains(q, label) and length(label) >= 3) where q <> '')
select 'parameters' as category, 'parameter' as field, q.text, h.iri, h.label, cast(h.pass as integer) as pass from q left join (select * from h qualify row_number() over (partition by text order by pass, so, ord, label) = 1) h using (text) where q.q <> ''""")
def mt2_contained(load):
    """MT2 without the last pass, for every parameter name: exact, synonym, substring."""
    q = _values(load, "parameter").withColumn("category", F.lit("parameters"))
    return cascade.map_vocabulary(q, load("ontology_index"), load("ontology_synonym"), near=False).select("category", "field", "text", "iri", "label", F.col("pass").cast("int").alias("pass"))


@query()
def mt2_vocabulary(load):
    """MT2 for every parameter name: exact, synonym, substring, ratio."""
    q = _values(load, "parameter").withColumn("category", F.lit("parameters"))
    return cascade.map_vocabulary(q, load("ontology_index"), load("ontology_synonym"))


QUERIES, SQL = query.queries, query.sql
