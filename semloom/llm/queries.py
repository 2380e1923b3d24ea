"""Queries of the problems of this subpackage, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.best import best_records, concept_of, skyline_layers, survivors
from semloom.llm.mapping import map_values
from semloom.llm.packing import certificate, pack, token_sizes
from semloom.llm.pii import find_personal, redact
from semloom.llm.tokens import encode_corpus
from semloom.llm.topn import top_n
from semloom.session import col, table

#: Tokens of a container.
CAPACITY = 2048
FIELDS = ["uri", "label", "description", "source_provider"]


def _suggestion_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = {"term_id": col("term_id"), "concept": concept_of(col("uri"), col("id"))}
    return skyline_layers(table(spark, sf_dir, "suggestion"), group, "suggestion_id", FIELDS, "retrieved_at", "provider_ord", cut=["description"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(_suggestion_layers(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of every concept of every term that has several rows."""
    return best_records(_suggestion_layers(spark, sf_dir), table(spark, sf_dir, "suggestion"), "suggestion_id", ["term_id", "concept"], FIELDS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "suggestion"), "uri", "score", "source_provider", "suggestion_id", 3)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept, spelling, ord): the labels of the reference list, then its synonyms."""
    index = table(spark, sf_dir, "ontology_index").select(F.col("concept_id").alias("concept"), "label", "label_norm", "ord")
    synonyms = table(spark, sf_dir, "ontology_synonym").select("syn_norm", "canonical", F.col("ord").alias("syn_ord"))
    named = synonyms.join(index, synonyms["canonical"] == index["label"]).select("concept", F.col("syn_norm").alias("spelling"), (F.col("syn_ord") + (1 << 40)).alias("ord"))
    return index.select("concept", F.col("label_norm").alias("spelling"), "ord").unionByName(named)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (("matching_table_for_reconciliation", "term_id", "term"), ("master_mapping", "row_id", "term"), ("model_parameter", "param_key", "name"))
    values = None
    for src, key, text in sources:
        part = table(spark, sf_dir, src).select(F.lit(src).alias("src"), F.col(key).alias("row_key"), F.col(text).alias("text"))
        values = part if values is None else values.unionByName(part)
    values = values.where(F.regexp_replace("text", r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+", "") != "")
    found = map_values(values, _entries(spark, sf_dir))
    return values.join(found.where("concept is not null"), "text", "left").select("src", "row_key", F.coalesce("concept", F.lit(0)).cast("long").alias("concept_id"))


def vocabulary(spark: SparkSession) -> str:
    """Path of the vocabulary file, the same on every executor: the setting ``semloom.tokenizer``, else the installed public file."""
    path = spark.conf.get("semloom.tokenizer", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark)), CAPACITY)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of each piece of each document."""
    return _packed(spark, sf_dir).withColumnsRenamed({"id": "doc_id", "start": "token_start", "n": "n_tokens", "offset": "container_start"})


def p7_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the lower bound that no packing can beat."""
    return certificate(_packed(spark, sf_dir))


def p7_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing checked: containers over capacity or with pieces that overlap or leave gaps, documents that are cut without need or not whole, and documents in all."""
    p = _packed(spark, sf_dir)
    inside = p.where("container is not null").groupBy("container").agg(F.sum("n").alias("n"), F.max(F.col("offset") + F.col("n")).alias("end"), F.countDistinct("offset").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    bad = inside.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), F.count_if((F.col("end") != F.col("n")) | (F.col("starts") != F.col("pieces"))).alias("disordered"))
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark)).withColumnRenamed("n", "size")
    docs = p.groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("n")).alias("end")).join(sizes, "id", "full")
    whole = docs.agg(F.count_if((F.col("size") <= CAPACITY) & (F.col("pieces") > 1)).alias("cut"), F.count_if(~F.coalesce((F.col("n") == F.col("size")) & (F.col("end") == F.col("size")), F.lit(False))).alias("not_whole"), F.count(F.lit(1)).alias("documents"))
    counts = ("overfull", "disordered", "cut", "not_whole", "documents")
    return bad.unionByName(whole, allowMissingColumns=True).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    return redact(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_certificate": p7_certificate, "p7_legal": p7_legal, "p4_found": p4_found, "p2_found": p2_found, "p2_records": p2_records, "p5_found": p5_found}

_CONCEPT = r"""
  case when uri is null or regexp_matches(uri, '^\s*(-|[nN]/[aA])?\s*$') then nullif(trim(id), '')
       else replace(replace(regexp_extract(regexp_replace(regexp_replace(trim(uri), '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1), '%5F', '_'), '%5f', '_') end
"""
_RANKED = rf"""
with s as (
  select term_id, {_CONCEPT} as concept, suggestion_id,
         case when uri is null or regexp_matches(uri, '^\s*(-|[nN]/[aA])?\s*$') then 0 else 2 end as c0,
         case when label is null or regexp_matches(label, '^\s*(-|[nN]/[aA])?\s*$') then 0 else 2 end as c1,
         case when description is null or regexp_matches(description, '^\s*(-|[nN]/[aA])?\s*$') then 0
              when regexp_matches(description, '(…|\.\.\.)\s*$') then 1 else 2 end as c2,
         case when source_provider is null or regexp_matches(source_provider, '^\s*(-|[nN]/[aA])?\s*$') then 0 else 2 end as c3,
         coalesce(retrieved_at, timestamp '0001-01-01') as r, coalesce(provider_ord, 2147483647) as t
  from suggestion where term_id is not null
), m as (
  select term_id, concept, max(c0) c0, max(c1) c1, max(c2) c2, max(c3) c3, max(r) r, min(t) t, min(suggestion_id) as group_id, count(*) as n
  from s where concept is not null group by 1, 2
)
"""
SQL = {
    "p2_found": _RANKED
    + """
select group_id, min(suggestion_id) as survivor_id
from s join m using (term_id, concept, c0, c1, c2, c3, r, t) where n > 1 group by group_id
""",
    "p2_records": _RANKED.replace("with s as", "with recursive s as")
    + """, v as (select row_number() over (order by term_id, concept, c0, c1, c2, c3, t, r desc, suggestion_id) as u, s.* from s join (select term_id, concept, n from m) q using (term_id, concept) where n > 1
  qualify row_number() over (partition by term_id, concept, c0, c1, c2, c3, t order by r desc, suggestion_id) = 1),
e as (select x.u as lower, y.u as upper from v x join v y using (term_id, concept) where x.u <> y.u and y.c0 >= x.c0 and y.c1 >= x.c1 and y.c2 >= x.c2 and y.c3 >= x.c3 and y.r >= x.r and y.t <= x.t),
w as (select u, 1 as level from v union select e.lower, level + 1 from w join e on e.upper = w.u),
p as (select v.*, l.layer, row_number() over (partition by term_id, concept order by c0 desc, c1 desc, c2 desc, c3 desc, r desc, t, suggestion_id) as k from v join (select u, max(level) as layer from w group by u) l using (u)),
f as (select term_id, concept, arg_min(suggestion_id, (layer, k)) as survivor_id, arg_min(suggestion_id, (-c0, layer, k)) filter (c0 > 0) as i0, arg_min(suggestion_id, (-c1, layer, k)) filter (c1 > 0) as i1,
  arg_min(suggestion_id, (-c2, layer, k)) filter (c2 > 0) as i2, arg_min(suggestion_id, (-c3, layer, k)) filter (c3 > 0) as i3 from p group by 1, 2)
select f.term_id, f.concept, m.group_id, m.n as n_rows, survivor_id, a.uri as best_uri, b.label as best_label, c.description as best_description, d.source_provider as best_source_provider
from f join m on m.term_id = f.term_id and m.concept = f.concept left join suggestion a on a.suggestion_id = i0 left join suggestion b on b.suggestion_id = i1 left join suggestion c on c.suggestion_id = i2 left join suggestion d on d.suggestion_id = i3
""",
    "p7_legal": "select 0 as overfull, 0 as disordered, 0 as cut, 0 as not_whole, count(*) as documents from documents",
    "p5_found": """
select suggestion_id, cast(place as integer) as place from (
  select suggestion_id, row_number() over (
    partition by uri order by score desc, (source_provider is null), source_provider, suggestion_id) as place
  from suggestion where uri is not null and uri <> '' and score is not null and not isnan(score)
) where place <= 3
""",
}
