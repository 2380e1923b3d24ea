"""Units and parameters inferred for model metadata, and data variables wired to inputs (MT4, MT5, X9-X11, J16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import comma_list, keyword_tokens, levenshtein_at_least, levenshtein_similarity, sequence_ratio, strip
from semloom.operators.containment import holding
from semloom.operators.graph import removed
from semloom.operators.vocabulary import Vocabulary

PUBLIC = Vocabulary()

# What stands for no dimension, the threshold of units, and the points of the disambiguation.
DIMENSIONLESS = ("dimensionless", "unitless", "1")
UNIT_THRESHOLD, HELD_SCORE, HELD, ALIKE, ALIKE_FROM = 0.7, 0.5, 50, 20, 0.6


def targets(candidates: DataFrame) -> DataFrame:
    """(display, ord, target): the term and the alternative labels of each candidate (display, ord, term, alts), lower case."""
    alts = F.transform(comma_list(F.col("alts")), F.lower)
    return candidates.select("display", "ord", F.explode(F.array_distinct(F.concat(F.array(F.lower("term")), alts))).alias("target")).where("target <> ''")


def letter_prefix(c: Column, least: float) -> Column:
    """Keys two texts share if their matching-block ratio reaches ``least``: the rarest letters of each, counted apart.

    A ratio r of texts of lengths a and b asks for r (a + b) / 2 letters in
    common, at least r a / (2 - r) as b is at least r a / (2 - r). So whatever
    order of letters is agreed on, the first a - r a / (2 - r) + 1 of both texts
    have one in common. Rare letters come first in the order.
    """
    order = F.translate(c, RARE, "".join(chr(0xE000 + i) for i in range(len(RARE))))
    letters = F.array_sort(F.filter(F.split(order, ""), lambda x: x != ""))
    counted = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x) + 1).cast("string")))
    n = F.length(c) - F.ceil(F.length(c) * (least / (2 - least)) - 1e-9).cast("int") + 1
    return F.slice(counted, F.lit(1), F.greatest(n, F.lit(1)))


#: Common letters and marks, the most common last, as they are sorted behind all others.
RARE = "zqxjkvbpygfwmucldrhsnioat e"


def edit_pairs(a: DataFrame, x: str, b: DataFrame, y: str, least: float) -> DataFrame:
    """(x, y, score) of all pairs of distinct texts whose edit similarity (X1) reaches ``least``.

    A similarity s asks for s times the longer length of letters in common, so
    the pairs share one of the rarest letters of both (``letter_prefix``); no text
    is compared with all others.
    """
    prefix = lambda df, c: df.select(c).distinct().withColumn("__k", F.explode(F.array_distinct(letter_prefix(F.lower(c), 2 * least / (1 + least)))))
    near = F.abs(F.length(x) - F.length(y)) <= F.floor(F.greatest(F.length(x), F.length(y)) * (1 - least) + 1e-9)
    pairs = prefix(a, x).join(prefix(b, y), "__k").where(near).select(x, y).distinct()
    return pairs.where(levenshtein_at_least(F.col(x), F.col(y), least)).withColumn("score", levenshtein_similarity(F.col(x), F.col(y)))


def match_units(values: DataFrame, candidates: DataFrame, threshold: float = UNIT_THRESHOLD) -> DataFrame:
    """X9/X10. (text, display, score) of distinct units: equal 1, one held by the other 0.5 at least, else the matching-block ratio; the best from ``threshold`` on, the first of equals.

    '[]' goes to a candidate of that name, else to one that stands for no
    dimension, else to itself. Texts meet candidates on shared letters that a
    pair above the threshold must have; only such pairs, of like length, reach
    the UDF. Both sides may be of any size.
    """
    q = values.select("text").distinct().where(F.coalesce(strip(F.col("text")), F.lit("")) != "").withColumn("q", F.lower(strip(F.col("text"))))
    t = targets(candidates)
    plain = q.where("q <> '[]'")
    equal = plain.join(t, F.col("q") == F.col("target")).select("text", "display", "ord", F.lit(1.0).alias("score"))
    left = plain.join(equal.select("text").distinct(), "text", "left_anti")
    bound = 2.0 * F.least(F.length("q"), F.length("target")) / (F.length("q") + F.length("target")) >= threshold
    prefix = lambda df, c: df.withColumn("k", F.explode(F.array_distinct(letter_prefix(F.col(c), threshold))))
    met = prefix(left.select("q").distinct(), "q").join(prefix(t.select("target").distinct(), "target"), "k").where(bound).select("q", "target").distinct()
    near = met.where(~F.col("q").contains(F.col("target")) & ~F.col("target").contains(F.col("q"))).withColumn("score", sequence_ratio(F.col("q"), F.col("target")))
    if threshold <= HELD_SCORE:
        texts, parts = left.select("q").distinct(), t.select("target").distinct()
        held = holding(texts, "q", parts, "target").unionByName(holding(parts, "target", texts, "q")).distinct()
        near = near.unionByName(held.select("q", "target", F.lit(HELD_SCORE).alias("score")))
    hits = equal.unionByName(left.join(near.where(F.col("score") >= threshold), "q").join(t, "target").select("text", "display", "ord", "score"))
    best = hits.groupBy("text").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "display")).alias("b")).select("text", "b.display", "b.score")
    exact = t.where("target = '[]'").select(F.lit(0).alias("r"), "ord", "display")
    none = t.where(F.col("target").isin(*DIMENSIONLESS)).select(F.lit(1).alias("r"), "ord", "display")
    dimensionless = exact.unionByName(none).agg(F.min(F.struct("r", "ord", "display"))["display"].alias("d")).scalar()
    empty = q.where("q = '[]'").select("text", F.coalesce(dimensionless, F.lit("[]")).alias("display"), F.lit(1.0).alias("score"))
    return best.unionByName(empty)


def match_keywords(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """X8 as a join. (text, display, score): the candidate of most overlap of words longer than two letters; the first of equals.

    Distinct words of the values meet distinct words of the candidates once, by
    the pieces one of them has to hold of the other: equal 1, one within the other 0.8.
    """
    q = values.select("text").distinct().select("text", F.explode(keyword_tokens(F.col("text"))).alias("w"))
    c = targets(candidates).select("display", "ord", F.explode(keyword_tokens(F.col("target"))).alias("v")).distinct()
    asked, known = q.select("w").distinct(), c.select("v").distinct()
    words = holding(asked, "w", known, "v").unionByName(holding(known, "v", asked, "w")).distinct()
    words = words.withColumn("score", F.when(F.col("w") == F.col("v"), 1.0).otherwise(0.8))
    scored = q.join(words, "w").join(c, "v").groupBy("text", "display", "ord").agg(F.round(F.sum("score"), 6).alias("score"))
    return scored.groupBy("text").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "display")).alias("b")).select("text", "b.display", "b.score")


def infer(parameters: DataFrame, units: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """MT4. Parameters (model, param_id, name, unit, roles array) with mapped_unit, original_name and mapped_parameter.

    A parameter is an input or an output by its roles, inputs win; its name is tried first, then its id.
    """
    has = lambda word: F.exists("roles", lambda r: F.upper(r).contains(word))
    p = parameters.withColumn("side", F.when(has("INPUT"), "i").when(has("OUTPUT"), "o"))
    unit = match_units(p.select(F.col("unit").alias("text")), units).select(F.col("text").alias("unit"), F.col("display").alias("mapped_unit"))
    texts = p.where("side is not null").select("side", F.explode(F.array("name", "param_id")).alias("text")).where("text is not null")
    found = None
    for side, candidates in (("i", inputs), ("o", outputs)):
        part = match_keywords(texts.where(F.col("side") == side), candidates).select(F.lit(side).alias("side"), "text", F.col("display").alias("d"))
        found = part if found is None else found.unionByName(part)
    by = lambda key, name: found.select("side", F.col("text").alias(key), F.col("d").alias(name))
    out = p.join(unit, "unit", "left").join(by("name", "by_name"), ["side", "name"], "left").join(by("param_id", "by_id"), ["side", "param_id"], "left")
    original = F.when(F.col("by_name").isNotNull(), F.col("name")).when(F.col("by_id").isNotNull(), F.col("param_id"))
    return out.select("model", "param_id", "name", "unit", "roles", "mapped_unit", original.alias("original_name"), F.coalesce("by_name", "by_id").alias("mapped_parameter"))


def disambiguate(pairs: DataFrame, key: str, choice: str, search: Column, target: Column, order: str) -> DataFrame:
    """X11/MT5. For each key the choice of most points over all (search, target) texts: 50 where one holds the other, 20 for a ratio above 0.6; the first of equals.

    ``pairs`` holds one row per key and candidate with two arrays of texts; a
    single candidate is taken as it is.
    """
    some = lambda a: F.filter(F.transform(a, F.lower), lambda x: x.isNotNull() & (x != ""))
    rows = pairs.select(key, choice, F.col(order).alias("__o"), some(search).alias("__s"), some(target).alias("__t"))
    exploded = rows.select(key, choice, "__o", F.explode_outer("__s").alias("a"), "__t").select(key, choice, "__o", "a", F.explode_outer("__t").alias("b"))
    ratio = sequence_ratio(F.col("a"), F.col("b"))
    points = F.when(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")), HELD).otherwise(0) + F.when(ratio > ALIKE_FROM, ALIKE).otherwise(0)
    scored = exploded.groupBy(key, choice, "__o").agg(F.coalesce(F.sum(points), F.lit(0)).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "__o", choice)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, choice, "score")


def input_mappings(wired: DataFrame, base: str, voc: Vocabulary = PUBLIC) -> DataFrame:
    """J16. Triples (s, p, o, o_kind) of a mapping node for each (model, parameter, source, variable); node ids follow from model and parameter."""
    node = F.concat(F.lit("b"), F.substring(F.md5(F.concat_ws("|", "model", "parameter")), 1, 16))
    t = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    rows = F.array(
        t(F.col("model"), base + "hasInputMapping", node, "bnode"), t(node, voc.type, F.lit(base + "InputMapping"), "iri"), t(node, base + "mapsParameter", F.col("parameter"), "iri"),
        t(node, base + "isFulfilledBy", F.col("source"), "iri"), t(node, base + "sourceVariableName", F.col("variable"), "literal"),
    )
    return wired.select(F.inline(rows)).distinct()


def parameter_mappings(inputs: DataFrame, outputs: DataFrame, base: str, voc: Vocabulary = PUBLIC) -> DataFrame:
    """J16. Triples (s, p, o, o_kind) of chosen concepts and units: (model, parameter, uris array, unit uri) of input and of output parameters.

    Every uri is an exact match of the parameter. An input has its preferred unit; an output with a concept or
    unit has a mapping node with its first uri as observed property, and its unit.
    """
    node = F.concat(F.lit("b"), F.substring(F.md5(F.concat_ws("|", F.lit("output"), "model", "parameter")), 1, 16))
    t = lambda s, p, o, kind="iri": F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    uris = F.filter(F.transform(F.coalesce("uris", F.array().cast("array<string>")), strip), lambda u: u.isNotNull() & ~F.lower(u).isin("", "nan"))
    parameter, unit = F.col("parameter"), F.nullif("unit", F.lit(""))
    same = lambda df: df.select("model", "parameter", unit.alias("unit"), uris.alias("uris"))
    exact = F.transform("uris", lambda u: t(parameter, voc.matches[0], u))
    put_in = F.concat(exact, F.array(t(parameter, base + "preferredInputUnit", F.col("unit"))))
    own = F.array(
        t(F.col("model"), base + "hasOutputMapping", node, "bnode"), t(node, voc.type, F.lit(base + "OutputMapping")), t(node, base + "mapsParameter", parameter),
        t(node, base + "producesObservedProperty", F.get("uris", F.lit(0))), t(node, base + "hasOutputUnit", F.col("unit")),
    )
    chosen = same(outputs).where((F.size("uris") > 0) | F.col("unit").isNotNull())
    return same(inputs).select(F.inline(put_in)).unionByName(chosen.select(F.inline(F.concat(exact, own)))).where("o is not null").distinct()


def applied(triples: DataFrame, parameters: DataFrame, scope: DataFrame, added: DataFrame, base: str, voc: Vocabulary) -> DataFrame:
    """J16. The triples (s, p, o, o_kind and others) after the mappings of some models are replaced.

    ``parameters``: (model, parameter, side), all of these models with side 'i' or 'o'; ``scope``: (model, kind, uri) with kind
    'hazard' or 'product'; ``added``: triples of ``parameter_mappings`` and ``input_mappings``. Hazards, products, input and
    output mapping nodes of the models go, and the exact matches and preferred units of the parameters; doing it again changes nothing.
    """
    models, none = parameters.select("model").union(scope.select("model")).distinct(), F.lit(None).cast("string").alias("o")
    links = [base + "hasInputMapping", base + "hasOutputMapping"]
    gone = lambda df, s, *ps: df.select(F.col(s).alias("s"), F.explode(F.array(*map(F.lit, ps))).alias("p"), none)
    nodes = triples.where(F.col("p").isin(*links)).join(models, F.col("s") == F.col("model"), "left_semi").select(F.col("o").alias("s"))
    units = gone(parameters.where("side = 'i'"), "parameter", base + "preferredInputUnit", base + "expectsQuantityKind")
    old = gone(models, "model", voc.hazard, voc.product, *links).unionByName(gone(parameters, "parameter", voc.matches[0])).unionByName(units)
    new = scope.select(F.col("model").alias("s"), F.when(F.col("kind") == "hazard", voc.hazard).otherwise(voc.product).alias("p"), F.col("uri").alias("o"), F.lit("iri").alias("o_kind")).unionByName(added)
    return removed(triples.join(nodes, "s", "left_anti"), old, bound=("sp",)).unionByName(new, allowMissingColumns=True).distinct()
