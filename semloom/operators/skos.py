"""Vocabularies: unpivoted wide tables, upsert of concepts, mapping conflicts and their resolution, prefixes, Turtle output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import comma_list, slugify, strip, turtle_iri, turtle_literal, uri_namespace
from semloom.operators.vocabulary import MATCH_NAMES, NAMESPACES, Vocabulary, iri

PUBLIC = Vocabulary()
#: Mapping properties by their spelling in a table, lower case, as CURIE or in full.
MATCHES = {spelt.lower(): iri(f"skos:{m}") for m in MATCH_NAMES for spelt in (f"skos:{m}", iri(f"skos:{m}"))}
#: The order of properties in output.
ORDER = (PUBLIC.title, PUBLIC.description, PUBLIC.in_scheme, PUBLIC.pref_label, PUBLIC.alt_label, PUBLIC.definition, PUBLIC.source, *PUBLIC.matches)
#: What a minted scheme is called and how it is described; {} stands for its group.
SCHEME_TITLE, SCHEME_TEXT = "{} Vocabulary", "Concepts of the group {}."


def long_uris(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """F12/F13. (key, ord, uri) of several uri columns; trimmed, without empty ones and 'nan'."""
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), strip(F.col(c)).alias("uri")) for i, c in enumerate(columns, 1)))
    return df.select(key, F.inline(F.filter(pairs, lambda x: x["uri"].isNotNull() & ~F.lower(x["uri"]).isin("", "nan"))))


def first_uri(columns: Sequence[str]) -> Column:
    """F10. The first non-empty of several columns."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def first_row_by_uri(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """F11. (uri, key): for each uri the first row that has it in any column."""
    return long_uris(df, key, columns).groupBy("uri").agg(F.min(key).alias(key))


def vocabulary_type(value: Column, types: Mapping[str, tuple[str, Sequence[str]]]) -> Column:
    """F16. The first type whose base uri is in the value, or one of whose groups is, in any case; else null."""
    out = None
    for name, (base, groups) in types.items():
        hit = reduce(lambda a, b: a | b, (F.lower(value).contains(g.lower()) for g in groups), value.contains(base))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def upsert(rows: DataFrame, existing: DataFrame, base: str, lang: str = "en", title: str = SCHEME_TITLE, text: str = SCHEME_TEXT, voc: Vocabulary = PUBLIC) -> DataFrame:
    """J12. Triples (s, p, o, o_lang, o_kind, is_new) that a wide table adds to a vocabulary.

    ``rows``: row_id, term, alt_label, concept_group and arrays of definitions,
    sources and, where it has the column, mappings (match_type, uri). A row belongs to the existing concept
    whose preferred label is its term, else to one that has one of its
    alternative labels, else to the concept minted for its term; rows of one term
    are one concept, whatever their order. Blank terms are skipped. Mappings with
    an unknown match type are skipped; those that conflict (``conflicts``) aren't added.
    """
    t = rows.where(F.coalesce(strip(F.col("term")), F.lit("")) != "").withColumn("alts", comma_list(F.col("alt_label")))
    concepts = existing.where((F.col("p") == voc.type) & (F.col("o") == voc.concept)).select("s").distinct()
    named = lambda p, v: existing.where(F.col("p") == p).join(concepts, "s").groupBy(F.col("o").alias(v)).agg(F.min("s").alias(f"by_{v}"))
    by_alt = t.select("term", F.explode("alts").alias("alt")).join(named(voc.alt_label, "alt"), "alt").groupBy("term").agg(F.min("by_alt").alias("by_alt"))
    slug = F.when(strip(F.coalesce("concept_group", F.lit(""))) != "", F.concat(slugify(F.col("concept_group")), F.lit("/"))).otherwise("")
    minted = t.groupBy("term").agg(F.min_by(F.concat(F.lit(base + "concept/"), slug, slugify(F.col("term"))), "row_id").alias("minted"))
    at = minted.join(named(voc.pref_label, "term"), "term", "left").join(by_alt, "term", "left")
    at = at.select("term", F.coalesce("by_term", "by_alt", "minted").alias("s"), F.coalesce("by_term", "by_alt").isNull().alias("is_new"))
    joined = t.join(at, "term")
    none = F.lit(None).cast("string")
    row = lambda p, o, lng, kind: F.struct(F.lit(p).alias("p"), o.alias("o"), (F.lit(lng) if lng else none).alias("o_lang"), F.lit(kind).alias("o_kind"))
    scheme = F.concat(F.lit(base + "scheme/"), slugify(F.col("concept_group")))
    grouped = strip(F.coalesce("concept_group", F.lit(""))) != ""
    own = F.when(F.col("is_new"), F.array(row(voc.type, F.lit(voc.concept), None, "iri"), row(voc.pref_label, F.col("term"), lang, "literal")))
    in_scheme = F.when(F.col("is_new") & grouped, F.array(row(voc.in_scheme, scheme, None, "iri")))
    lists = [F.transform("alts", lambda a: row(voc.alt_label, a, lang, "literal")), F.transform("definitions", lambda d: row(voc.definition, d, lang, "literal")), F.transform("sources", lambda x: row(voc.source, strip(x), None, "literal"))]
    added = joined.select("s", "is_new", F.explode(F.flatten(F.filter(F.array(own, in_scheme, *lists), lambda x: x.isNotNull()))).alias("t")).select("s", "t.*", "is_new").where("o is not null")
    schemes = t.where(grouped).select(F.concat(F.lit(base + "scheme/"), slugify(F.col("concept_group"))).alias("s"), "concept_group").groupBy("s").agg(F.min("concept_group").alias("g"))
    filled = lambda template: F.replace(F.lit(template), F.lit("{}"), F.col("g"))
    heads = schemes.select("s", F.explode(F.array(row(voc.type, F.lit(voc.concept_scheme), None, "iri"), row(voc.title, filled(title), lang, "literal"), row(voc.description, filled(text), lang, "literal"))).alias("t"), F.lit(True).alias("is_new"))
    added = added.unionByName(heads.select("s", "t.*", "is_new"))
    if "mappings" in rows.columns:
        wanted = joined.select("s", "is_new", F.inline("mappings")).where("uri is not null and match_type is not null")
        clash = conflicts(wanted.select("s", "match_type", "uri"), existing).select("s", "p", F.col("new_uri").alias("o")).distinct()
        known = F.create_map(*(F.lit(x) for kv in MATCHES.items() for x in kv))
        linked = wanted.select("s", "is_new", F.element_at(known, F.lower(strip(F.col("match_type")))).alias("p"), strip(F.col("uri")).alias("o")).where("p is not null and o <> ''").join(clash, ["s", "p", "o"], "left_anti")
        added = added.unionByName(linked.select("s", "p", "o", none.alias("o_lang"), F.lit("iri").alias("o_kind"), "is_new"))
    return added.groupBy("s", "p", "o", "o_lang", "o_kind").agg(F.max("is_new").alias("is_new"))


def conflicts(mappings: DataFrame, existing: DataFrame) -> DataFrame:
    """J13. (s, p, existing_uri, new_uri): same concept and property, same namespace, another uri.

    ``mappings``: s, match_type, uri. Existing mappings count, and among the new
    ones the first by uri of a namespace; unknown match types are skipped.
    """
    known = F.create_map(*(F.lit(x) for kv in MATCHES.items() for x in kv))
    new = mappings.withColumn("p", F.element_at(known, F.lower(strip(F.col("match_type"))))).withColumn("uri", strip(F.col("uri"))).where("p is not null and uri <> ''").select("s", "p", "uri", uri_namespace(F.col("uri")).alias("ns")).distinct()
    old = existing.where(F.col("p").isin(*PUBLIC.matches)).select("s", "p", F.col("o").alias("existing_uri"), uri_namespace(F.col("o")).alias("ns"))
    first_old = old.groupBy("s", "p", "ns").agg(F.min("existing_uri").alias("existing_uri"), F.collect_set("existing_uri").alias("all_old"))
    seen = new.join(first_old, ["s", "p", "ns"], "left").withColumn("first_new", F.min("uri").over(Window.partitionBy("s", "p", "ns")))
    held = F.coalesce("existing_uri", "first_new")
    return seen.where((F.col("uri") != held) & ~F.coalesce(F.array_contains("all_old", F.col("uri")), F.lit(False))).select("s", "p", held.alias("existing_uri"), F.col("uri").alias("new_uri"))


def report(added: DataFrame, clash: DataFrame, voc: Vocabulary = PUBLIC) -> DataFrame:
    """A14. (kind, s) of what an upsert did, each once and in order: 'conflict', 'new' and 'updated' concepts."""
    concepts = added.where(~F.col("p").isin(voc.title, voc.description) & (F.col("o") != voc.concept_scheme)).groupBy("s").agg(F.max("is_new").alias("new"))
    return concepts.select(F.when(F.col("new"), "new").otherwise("updated").alias("kind"), "s").unionByName(clash.select(F.lit("conflict").alias("kind"), "s").distinct()).orderBy("kind", "s")


def resolved(triples: DataFrame, choices: DataFrame) -> DataFrame:
    """J14. Triples after choices (s, p, existing_uri, new_uri, choice): 'keep', 'replace', or 'both' (the new one as a close match)."""
    replaced = choices.where("choice = 'replace'")
    kept = triples.join(replaced.select("s", "p", F.col("existing_uri").alias("o")).distinct(), ["s", "p", "o"], "left_anti")
    rest = {c: F.lit(None).cast(t) for c, t in triples.dtypes if c not in ("s", "p", "o")}
    iri = {"o_kind": F.lit("iri")} if "o_kind" in rest else {}
    put = replaced.select("s", "p", F.col("new_uri").alias("o")).unionByName(choices.where("choice = 'both'").select("s", F.lit(PUBLIC.matches[1]).alias("p"), F.col("new_uri").alias("o")))
    return kept.unionByName(put.withColumns({**rest, **iri}) if rest else put).distinct()


def common_prefix(c: Column) -> Column:
    """A13. Longest common prefix of a group's texts: that of the least and the greatest, as everything between shares it."""
    low, high = F.min(c), F.max(c)
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))


def read_prefixes(lines: DataFrame) -> DataFrame:
    """S13. (namespace, prefix, ord) of lines ``@prefix name: <ns>`` or ``PREFIX name: <ns>``, each pair once."""
    rule = r"(?i)^\s*(?:@prefix|PREFIX)\s+([\w\-]+):\s+<([^>]+)>"
    found = lines.select(F.regexp_extract("value", rule, 1).alias("prefix"), F.trim(F.regexp_extract("value", rule, 2)).alias("namespace"), F.monotonically_increasing_id().alias("ord")).where("prefix <> ''")
    return found.groupBy("namespace", "prefix").agg(F.min("ord").alias("ord"))


def assign_prefixes(uris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """J15. (prefix, namespace) for the uris by a list (namespace, prefix, ord).

    A uri belongs to its longest namespace of which a prefix can be chosen: the
    only one, else the one that most local names begin with (then the longest,
    then the first), else one that is part of the domain's name (the longest). A
    namespace is bound as far as all its uris share a path. The first binding of
    a prefix, by length of the listed namespace, stands.

    Uris meet the list by their scheme and host, which each namespace has in
    full; a listed namespace without a host is met by its first letters as far as
    its shortest kin goes, so none is left out.
    """
    listed = prefixes.groupBy("namespace").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "prefix"))), lambda x: x["prefix"]).alias("names"))
    # A namespace that ends within the host part ("http://x") is met by its scheme alone.
    host, scheme = r"^[A-Za-z][\w+.-]*://[^/#?]+[/#?]", r"^[A-Za-z][\w+.-]*:"
    key = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, host, 0), F.lit("")), F.nullif(F.regexp_extract(c, scheme, 0), F.lit("")), F.substring(c, 1, 1))
    keyed = listed.where("namespace <> ''").withColumn("k", key(F.col("namespace")))
    own = F.filter(F.array(F.regexp_extract("uri", host, 0), F.regexp_extract("uri", scheme, 0), F.substring("uri", 1, 1)), lambda k: k != "")
    met = uris.select("uri").where("uri <> ''").distinct().select("uri", F.explode(F.array_distinct(own)).alias("k"))
    pairs = met.join(keyed, "k").where(F.col("uri").startswith(F.col("namespace"))).drop("k")
    local = F.lower(F.substring("uri", F.length("namespace") + 1, F.length("uri")))
    votes = pairs.select("namespace", "names", F.posexplode("names").alias("i", "prefix"), "uri").withColumn("hit", F.when(F.substring(local, F.lit(1), F.length("prefix")) == F.lower("prefix"), 1).otherwise(0))
    score = votes.groupBy("namespace", "prefix", "i").agg(F.sum("hit").alias("hits"), F.max(F.size("names")).alias("names"))
    in_domain = F.lower(F.regexp_extract("namespace", "https?://([^/]+)", 1)).contains(F.lower("prefix"))
    kind = F.when(F.col("names") == 1, 3).when(F.col("hits") > 0, 2).when(in_domain, 1)
    w = Window.partitionBy("namespace").orderBy(F.col("kind").desc(), F.col("hits").desc(), F.length("prefix").desc(), "i")
    chosen = score.withColumn("kind", kind).where("kind is not null").withColumn("n", F.row_number().over(w)).where("n = 1").select("namespace", "prefix")
    own = pairs.join(chosen, "namespace").groupBy("uri").agg(F.max_by(F.struct("namespace", "prefix"), F.length("namespace")).alias("b")).select("uri", "b.*")
    shared = own.groupBy("namespace", "prefix").agg(common_prefix(F.col("uri")).alias("base"), F.count(F.lit(1)).alias("n"))
    cut = F.regexp_extract("base", "^(.*[/#])", 1)
    bound = F.when((F.col("n") > 1) & (F.length(cut) > F.length("namespace")), cut).otherwise(F.col("namespace"))
    return shared.groupBy("prefix").agg(F.max_by(F.struct(bound.alias("bound"), "n"), F.struct(F.length("namespace"), "namespace")).alias("b")).select("prefix", F.col("b.bound").alias("namespace"), F.col("b.n").alias("uris"))


def turtle(triples: DataFrame, prefixes: Mapping[str, str], voc: Vocabulary = PUBLIC, graph: str | None = None) -> DataFrame:
    """K3/T7. (class, s, block): one Turtle block per subject (with ``graph``, a column, per graph and subject); schemes come before concepts and others, properties in their order.

    IRIs are shortened by the given and the public prefixes, those of schemes and
    subjects stand in full. A subject's triples are gathered to its block, as the
    format asks for it.
    """
    known = {**NAMESPACES, **prefixes}
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("p")), F.lit(0)), F.lit(len(ORDER) + 1))
    node = F.when(F.col("p") == voc.in_scheme, F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(turtle_iri(F.col("o"), known))
    blank = lambda c: F.concat(F.lit("_:"), F.regexp_replace(c, "^_:", ""))
    obj = F.when(F.col("o_kind") == "literal", turtle_literal(F.col("o"), F.col("o_lang"))).when(F.col("o_kind") == "bnode", blank(F.col("o"))).otherwise(node)
    # One shuffle by subject: types, and properties with their objects.
    keys = ["s", graph] if graph else ["s"]
    gathered = triples.groupBy(*keys, "p").agg(F.array_sort(F.collect_set(obj)).alias("objects"), F.array_sort(F.collect_set("o")).alias("plain")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("p") != voc.type, F.struct(rank.alias("r"), "p", "objects")))).alias("props"),
        F.first(F.when(F.col("p") == voc.type, F.struct("objects", "plain")), ignorenulls=True).alias("types"),
    )
    body = F.transform("props", lambda x: F.concat(turtle_iri(x["p"], known), F.lit(" "), F.array_join(x["objects"], ", ")))
    head = F.when(F.col("types").isNotNull(), F.array(F.concat(F.lit("a "), F.array_join("types.objects", ", ")))).otherwise(F.array().cast("array<string>"))
    subject = F.when(F.col("s").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("s").startswith("_:"), F.concat(F.lit("<"), "s", F.lit(">"))).otherwise(blank(F.col("s")))
    block = F.concat(subject, F.lit(" "), F.array_join(F.concat(head, body), " ;\n    "), F.lit(" ."))
    has = lambda kind: F.coalesce(F.array_contains("types.plain", kind), F.lit(False))
    order = F.when(has(voc.concept), 1).when(has(voc.concept_scheme), 0).otherwise(2)
    return gathered.select(order.alias("class"), *keys, block.alias("block"))
