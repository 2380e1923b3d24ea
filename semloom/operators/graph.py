"""Graph patterns over triples as DataFrame plans: patterns, optional parts, unions, paths, and the graph queries built of them.

Triples have columns s, p, o, o_kind ('iri', 'literal', 'bnode') and o_lang.
A pattern gives one column per variable, so a basic graph pattern is a chain of
equi-joins on shared variables that the optimiser may reorder; OPTIONAL is a
left join, UNION a union by name, FILTER a where.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import local_name, strip
from semloom.operators.containment import holding
from semloom.operators.vocabulary import Vocabulary

PUBLIC = Vocabulary()
SCHEMA = "s string, p string, o string, o_kind string, o_lang string"


def _part(name: str, value: str | Sequence[str]) -> tuple[Column | None, str | None]:
    if isinstance(value, str) and value.startswith("?"):
        return None, value[1:]
    return (F.col(name) == value if isinstance(value, str) else F.col(name).isin(*value)), None


def pattern(triples: DataFrame, s: str, p: str | Sequence[str], o: str | Sequence[str], where: Column | None = None) -> DataFrame:
    """One column per variable ('?x') of a triple pattern; a list stands for alternatives. The same variable twice is an equality."""
    conditions, columns = [], {}
    for name, value in (("s", s), ("p", p), ("o", o)):
        condition, variable = _part(name, value)
        if condition is not None:
            conditions.append(condition)
        elif variable in columns:
            conditions.append(F.col(columns[variable]) == F.col(name))
        else:
            columns[variable] = name
    if where is not None:
        conditions.append(where)
    out = reduce(lambda d, c: d.where(c), conditions, triples)
    return out.select(*(F.col(c).alias(v) for v, c in columns.items()))


def path(triples: DataFrame, s: str, steps: Sequence[str | Sequence[str]], o: str) -> DataFrame:
    """A property path ``s step1/step2/... o``."""
    names = [s, *(f"?__{i}" for i in range(len(steps) - 1)), o]
    joined = bgp(*(pattern(triples, a, p, b) for a, p, b in zip(names, steps, names[1:])))
    return joined.drop(*(f"__{i}" for i in range(len(steps) - 1)))


def bgp(*parts: DataFrame) -> DataFrame:
    """Parts joined on the variables they share with what is before them."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("a part shares no variable with those before it")
        return a.join(b, shared)

    return reduce(join, parts)


def optional(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left joins on the shared variables."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "left"), parts, df)


def union(*parts: DataFrame) -> DataFrame:
    """Bag union by variable; variables a part lacks are unbound (null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(*graphs: DataFrame) -> DataFrame:
    """U2/S4. Union of graphs as sets of triples."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graphs).distinct()


#: The places of a pattern that may be bound; a pattern with none bound fits every triple.
BOUND = ("spo", "sp", "so", "po", "s", "p", "o")


def removed(triples: DataFrame, patterns: DataFrame, bound: Sequence[str] = BOUND) -> DataFrame:
    """U5. Triples without those that a pattern (s, p, o) fits; null in a pattern stands for anything.

    Patterns are parted by the places they bind, each part is an equi-join. Who
    knows which places are bound names them in ``bound``, then patterns of other
    kinds aren't looked for.
    """
    out = triples
    for mask in bound:
        own = patterns.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() if c in mask else F.col(c).isNull() for c in "spo"))).select(*mask).distinct()
        out = out.join(own, [*mask], "left_anti")
    if tuple(bound) == BOUND:
        every = patterns.agg(F.coalesce(F.bool_or(F.col("s").isNull() & F.col("p").isNull() & F.col("o").isNull()), F.lit(False))).scalar()
        out = out.where(~every)
    return out.select(*triples.columns)


def lang_matches(lang: Column, wanted: str) -> Column:
    """A language tag that is ``wanted`` or a variety of it."""
    return (F.lower(lang) == wanted.lower()) | F.lower(lang).startswith(wanted.lower() + "-")


def search_labels(triples: DataFrame, terms: DataFrame, types: Sequence[str], labels: Sequence[str], optionals: Mapping[str, str], n: int, lang: str | None = None, voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q1, Q2, Q4. Concepts of the types whose label holds the term, in any case: (term, s, label, optionals' columns), ``n`` per term.

    With ``lang`` only labels of that language or without one count. Terms are
    joined to labels on their first letters at any place of the label, then
    verified. Per term the first by label and iri are kept.
    """
    said = None if lang is None else F.col("o_lang").isNull() | (F.col("o_lang") == "") | lang_matches(F.col("o_lang"), lang)
    of_type = pattern(triples, "?s", voc.type, list(types) if len(types) > 1 else types[0]).distinct()
    kept = pattern(triples, "?s", labels, "?label", where=said).join(of_type, "s", "left_semi").distinct().withColumn("__l", F.lower("label"))
    asked = terms.select("term").distinct().where(strip(F.col("term")) != "").withColumn("__q", F.lower(strip(F.col("term"))))
    hits = holding(kept, "__l", asked, "__q").select("term", "s", "label").distinct()
    w = Window.partitionBy("term").orderBy("label", "s")
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    for variable, predicate in optionals.items():
        # Of several values the smallest, so that the result doesn't depend on order.
        hits = hits.join(pattern(triples, "?s", predicate, f"?{variable}").groupBy("s").agg(F.min(variable).alias(variable)), "s", "left")
    return hits.select("term", "s", "label", *optionals, "rank")


def concepts_in_schemes(triples: DataFrame, prefixes: Sequence[str], voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q5. (s, scheme, label) of concepts whose scheme begins with one of the prefixes, any number of them."""
    starts = reduce(lambda a, b: a | b, (F.col("scheme").startswith(p) for p in prefixes))
    return bgp(pattern(triples, "?s", voc.in_scheme, "?scheme").where(starts), pattern(triples, "?s", voc.pref_label, "?label"))


def regions(triples: DataFrame, levels: Sequence[str], voc: Vocabulary) -> DataFrame:
    """Q7/Q11. (region, level, label, wkt) of concepts of the levels that have a geometry; no levels give none."""
    shape = bgp(pattern(triples, "?region", voc.has_geometry, "?geometry"), pattern(triples, "?geometry", voc.as_wkt, "?wkt"))
    known = bgp(pattern(triples, "?region", voc.type, voc.concept), pattern(triples, "?region", voc.level, "?level").where(F.col("level").isin(*levels)), pattern(triples, "?region", voc.pref_label, "?label"))
    return bgp(known, shape).select("region", "level", "label", "wkt").distinct()


def region_shape(triples: DataFrame, region: str, voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q11. (wkt): the geometry of one region, the first by text of several."""
    return path(triples, region, [voc.has_geometry, voc.as_wkt], "?wkt").agg(F.min("wkt").alias("wkt")).where("wkt is not null")


def scope_links(triples: DataFrame, predicate: str, variable: str, voc: Vocabulary) -> DataFrame:
    """(model, variable): linked by way of a scope node or directly."""
    return union(path(triples, "?model", [voc.has_scope, predicate], f"?{variable}"), bgp(pattern(triples, "?model", voc.type, voc.model), pattern(triples, "?model", predicate, f"?{variable}")))


def direct_scope(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q16. Distinct (kind, uri) of hazards and products that stand anywhere in the graph."""
    kind = F.when(F.col("p") == voc.hazard, "hazard").otherwise("product")
    return triples.where(F.col("p").isin(voc.hazard, voc.product)).select(kind.alias("kind"), F.col("o").alias("uri")).distinct()


def name_of(triples: DataFrame, variable: str, out: str, predicates: Sequence[str] = (PUBLIC.label, PUBLIC.pref_label)) -> DataFrame:
    """(variable, out): the name by the first predicate that has one, the smallest of several."""
    rank = F.array_position(F.array(*map(F.lit, predicates)), F.col("p"))
    return triples.where(F.col("p").isin(*predicates)).groupBy(F.col("s").alias(variable)).agg(F.min(F.struct(rank.alias("r"), "o"))["o"].alias(out))


def catalogue(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q6. Distinct (product, product_label, hazard, hazard_label) of models; both need a label."""
    both = bgp(scope_links(triples, voc.product, "product", voc), scope_links(triples, voc.hazard, "hazard", voc)).select("product", "hazard").distinct()
    named = optional(both, name_of(triples, "product", "product_label"), name_of(triples, "hazard", "hazard_label"))
    return named.where("product_label is not null and hazard_label is not null").select("product", "product_label", "hazard", "hazard_label")


def find_models(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q8. (product, hazard, model): for each pair the first model by iri that has an identifier."""
    both = bgp(scope_links(triples, voc.product, "product", voc), scope_links(triples, voc.hazard, "hazard", voc), path(triples, "?model", voc.identifier, "?identifier"))
    return both.groupBy("product", "hazard").agg(F.min("model").alias("model"))


def unit_symbols(units: DataFrame, symbols: DataFrame) -> DataFrame:
    """Q10. ``units`` (iri) with the symbol by (iri, symbol), else the iri's local name, else 'unknown unit'."""
    return units.join(symbols.groupBy("iri").agg(F.min("symbol").alias("symbol")), "iri", "left").withColumn(
        "unit_name", F.coalesce("symbol", F.when(F.col("iri").rlike("[/#]"), F.nullif(local_name(F.col("iri")), F.lit(""))), F.lit("unknown unit"))
    )


def main_model(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q12. (model): the first composite model, else the first subject with parameters (or the section that holds them)."""
    a = pattern(triples, "?model", voc.type, voc.composite).select(F.lit(0).alias("r"), "model")
    b = pattern(triples, "?model", voc.has_parameter[0], "?__x").select(F.lit(1).alias("r"), "model")
    return a.unionByName(b).agg(F.min(F.struct("r", "model"))["model"].alias("model"))


def without_containers(models: DataFrame) -> DataFrame:
    """Q14. (model, name) without models whose name holds the name of another; all of them where none is left."""
    names = models.select("name").distinct()
    held = holding(names, "name", names.withColumnRenamed("name", "other"), "other").where("name <> other").select("name").distinct().withColumn("__held", F.lit(True))
    marked = models.join(held, "name", "left")
    none = marked.agg((F.count_if(F.col("__held").isNull()) == 0)).scalar()
    return marked.where(F.col("__held").isNull() | none).select(*models.columns)


def parameters(triples: DataFrame, codes: Mapping[str, str], voc: Vocabulary) -> DataFrame:
    """Q15/Q18. (model, param_id, name, unit, roles): parameters whose id doesn't end in a digit; roles are the set of classes.

    ``codes`` gives the class for the number that a class iri ends in. All
    properties of a parameter are gathered by one aggregation over its triples.
    """
    wanted = (voc.param_id, voc.name, voc.unit, voc.classification)
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    facts = triples.where(F.col("p").isin(*wanted)).groupBy(F.col("s").alias("param")).agg(
        one(voc.param_id).alias("own_id"), one(voc.name).alias("name"), one(voc.unit).alias("unit"), F.collect_set(F.when(F.col("p") == voc.classification, F.col("o"))).alias("classes")
    )
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    role = lambda c: F.coalesce(F.element_at(code, F.nullif(F.regexp_extract(c, r"^\w+:.*?(\d+)$", 1), F.lit(""))), F.upper(c))
    full = path(triples, "?model", voc.has_parameter, "?param").join(facts, "param").withColumn("param_id", F.coalesce("own_id", "name"))
    listed = full.where(F.col("param_id").isNotNull() & ~F.col("param_id").rlike("[0-9]$")).select("model", "param_id", "name", "unit", F.transform("classes", role).alias("roles"))
    return listed.groupBy("model", "param_id").agg(F.min("name").alias("name"), F.min("unit").alias("unit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"))


def connections(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q17. Distinct (source, target, name): models where a name is an output of one and an input of another."""
    named = triples.where(F.col("p").isin(voc.name, voc.classification)).groupBy(F.col("s").alias("param")).agg(
        F.collect_set(F.when(F.col("p") == voc.name, F.lower("o"))).alias("names"), F.collect_set(F.when(F.col("p") == voc.classification, F.upper("o"))).alias("classes")
    )
    io = path(triples, "?model", voc.has_parameter, "?param").join(named, "param").select("model", "classes", F.explode("names").alias("name"))
    side = lambda word, as_: io.where(F.array_contains("classes", word)).select(F.col("model").alias(as_), "name").distinct()
    return side("OUTPUT", "source").join(side("INPUT", "target"), "name").where("source <> target").select("source", "target", "name")


def scope_candidates(triples: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q19. (kind, label, uris) of each hazard or product node: its label, and the iris it may be known by (the node and its name)."""
    kind = F.when(F.col("p") == voc.hazard, "hazard").otherwise("product")
    nodes = triples.where(F.col("p").isin(voc.hazard, voc.product)).select(kind.alias("kind"), F.col("o").alias("node"), (F.col("o_kind") == "iri").alias("is_iri")).distinct()
    named = triples.where(F.col("p").isin(voc.label, voc.name)).groupBy(F.col("s").alias("node")).agg(
        F.min(F.when(F.col("p") == voc.label, strip(F.col("o")))).alias("label"), F.collect_set(F.when((F.col("p") == voc.name) & (F.col("o_kind") == "iri"), F.col("o"))).alias("names")
    )
    none = F.array().cast("array<string>")
    own = F.when(F.col("is_iri"), F.array("node")).otherwise(none)
    return nodes.join(named, "node", "left").select("kind", "node", "label", F.array_sort(F.array_distinct(F.concat(F.coalesce("names", none), own))).alias("uris"))


def variable_candidates(triples: DataFrame, uris: DataFrame, voc: Vocabulary) -> DataFrame:
    """Q22. (uri, source, variable, pref, alt, id) of what is an exact match of a uri; the variable's name falls back to the last part of the source's iri.

    Of several values of one property the smallest stands, so a source is one row.
    """
    found = uris.select("uri").distinct().join(pattern(triples, "?source", voc.matches[0], "?uri"), "uri").distinct()
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    facts = triples.where(F.col("p").isin(voc.variable_name, voc.pref_label, voc.alt_label)).groupBy(F.col("s").alias("source")).agg(one(voc.variable_name).alias("v"), one(voc.pref_label).alias("pref"), one(voc.alt_label).alias("alt"))
    tail = F.substring_index("source", "/", -1)
    return found.join(facts, "source", "left").select("uri", "source", F.coalesce("v", tail).alias("variable"), F.coalesce("pref", F.lit("")).alias("pref"), F.coalesce("alt", F.lit("")).alias("alt"), tail.alias("id"))


def match_by_uri(triples: DataFrame, uris: DataFrame, voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q20. (uri, concept): the concept itself, or one it is an exact, close or narrow match of."""
    own = uris.join(pattern(triples, "?uri", voc.type, voc.concept), "uri").select("uri", F.col("uri").alias("concept"))
    exact, close, _, narrow, _ = voc.matches
    linked = uris.join(pattern(triples, "?concept", [exact, close, narrow], "?uri"), "uri")
    return own.unionByName(linked.select("uri", "concept")).distinct()


def match_by_label(triples: DataFrame, values: DataFrame, voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q21. (text, concept): preferred or alternative label equal to the text, in any case."""
    labels = pattern(triples, "?concept", [voc.pref_label, voc.alt_label], "?label").select("concept", F.lower("label").alias("__l"))
    return values.select("text").distinct().join(labels, F.lower("text") == F.col("__l")).select("text", "concept").distinct()


def display_structs(triples: DataFrame, voc: Vocabulary = PUBLIC) -> DataFrame:
    """Q23. (s, display): first preferred label (else label), with up to two alternative labels that differ from it."""
    rank = F.when(F.col("p") == voc.pref_label, 0).otherwise(1)
    named = F.col("p").isin(voc.pref_label, voc.rdfs_label)
    # One aggregation by subject gives the name and the alternative labels.
    joined = triples.where(named | (F.col("p") == voc.alt_label)).groupBy("s").agg(
        F.min(F.when(named, F.struct(rank.alias("r"), "o")))["o"].alias("name"), F.array_sort(F.collect_set(F.when(F.col("p") == voc.alt_label, F.col("o")))).alias("alts")
    ).where("name is not null")
    two = F.slice(F.filter("alts", lambda a: a != F.col("name")), 1, 2)
    return joined.select("s", F.when(F.size(two) > 0, F.concat("name", F.lit(" ("), F.array_join(two, "; "), F.lit(")"))).otherwise(F.col("name")).alias("display"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J11. (node, level): longest path from a source; nodes on or behind a cycle come last with null.

    Each round takes away the nodes without open predecessors, as Kahn's order
    does; every other round the lineage is cut, so plans stay small.
    """
    open_nodes = nodes.select("node").distinct()
    open_edges = edges.select("source", "target").distinct()
    done = None
    for level in count():
        free = open_nodes.join(open_edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level))
        free = free.checkpoint()
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        open_nodes = open_nodes.join(free, "node", "left_anti").checkpoint()
        open_edges = open_edges.join(free.select(F.col("node").alias("source")), "source", "left_anti").checkpoint()
    rest = open_nodes.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)
