"""Cascaded matchers: exact, synonym, same tokens, prefix, overlap and near-miss passes over an ontology index (MT1, MT2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import jaccard, normalize, ratio_bound, sequence_ratio, tokens

# Limits of the passes.
OVERLAP, PREFIX_LENGTH, NEAR, NEAR_LENGTH, NEAR_LOOSE = 0.8, 6, 0.96, 10, 0.90
FIELDS_OF_INDIVIDUALS = ("unit", "unitCategory", "dataType", "classification")
FIELDS_OF_CLASSES = ("hazard", "product", "populationGroup", "modelClass")
#: Kinds of vocabulary and the fields that belong to them.
VOCABULARY_FIELDS = {
    "units": ("unit", "units", "unitCategory"),
    "classifications": ("classification", "modelClass", "modelSubClass"),
    "parameters": ("parameterType", "parameterClassification"),
    "organisms": ("hazard", "product", "populationGroup"),
    "general": ("language", "software", "format", "publicationType"),
}


def space_order(field: Column, space: Column, strict: bool = True) -> Column:
    """Pass 0: place of a space in the search order of a field; null where it isn't searched."""
    classes_first = field.isin(*FIELDS_OF_CLASSES)
    order = F.when(space == "class", F.when(classes_first, 0).otherwise(1)).when(space == "individual", F.when(classes_first, 1).otherwise(0))
    return F.when(field.isin(*FIELDS_OF_INDIVIDUALS) & (space != "individual"), None).otherwise(order) if strict else order


def deduplicated(index: DataFrame) -> DataFrame:
    """One row per space and label: the last iri, at the place of the first."""
    return index.groupBy("space", F.col("label_norm").alias("label")).agg(F.max_by("iri", "ord").alias("iri"), F.min("ord").alias("ord"))


def bag(t: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(t)), " ")


def best_rank(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The first hit of each query: by pass, then score, then order."""
    w = Window.partitionBy(*keys).orderBy("pass", F.col("score").desc(), "space_ord", "ord", "label")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def match_ontology(queries: DataFrame, index: DataFrame, synonyms: DataFrame, near: bool = True) -> DataFrame:
    """MT1. (text, field, iri, label, pass, score) of each distinct (text, field); null where no pass hits.

    1 exact, 2 synonym, 3 same tokens, 4 prefix with overlap, 5 overlap, 6 near
    miss of long texts. Passes 1 to 3 are equi-joins, 4 and 5 join on shared
    tokens; only what is left goes on, and only texts of pass 6 reach the UDF,
    blocked by their first or last two letters and bounded by length.
    """
    q = queries.select("text", "field").distinct().withColumn("q", normalize(F.col("text"))).where("q is not null and q <> ''")
    q = q.withColumn("tok", tokens(F.col("q")))
    o = deduplicated(index).where("space in ('class', 'individual')").withColumn("otok", tokens(F.col("label")))
    syn = synonyms.groupBy("syn_norm").agg(F.max_by("canonical", "ord").alias("canonical")).select("syn_norm", normalize(F.col("canonical")).alias("label"))
    placed = lambda df: df.withColumn("space_ord", space_order(F.col("field"), F.col("space"))).where("space_ord is not null")
    cols = ["text", "field", "iri", "label", "pass", "score", "space_ord", "ord"]
    hit = lambda df, n, score=F.lit(1.0): placed(df).withColumns({"pass": F.lit(n), "score": score}).select(*cols)
    exact = hit(q.join(o, q["q"] == o["label"]), 1)
    by_synonym = hit(q.join(syn, q["q"] == syn["syn_norm"]).drop("syn_norm").join(o, "label"), 2)
    same = hit(q.withColumn("bag", bag(F.col("tok"))).where("bag <> ''").join(o.withColumn("bag", bag(F.col("otok"))), "bag"), 3)
    equal = exact.unionByName(by_synonym).unionByName(same)
    open_ = q.join(equal.select("text", "field").distinct(), ["text", "field"], "left_anti")
    shared = open_.withColumn("t", F.explode(F.array_distinct("tok"))).join(o.withColumn("t", F.explode(F.array_distinct("otok"))), "t")
    # Overlap of 0.8 needs token sets of like size, tested before the pairs are made distinct.
    a, b = F.size(F.array_distinct("tok")), F.size(F.array_distinct("otok"))
    pairs = shared.where(F.least(a, b) >= F.greatest(a, b) * OVERLAP - 1e-9).select("text", "field", "q", "tok", "otok", "space", "label", "iri", "ord").distinct()
    pairs = pairs.withColumn("j", jaccard(F.col("tok"), F.col("otok"))).where(F.col("j") >= OVERLAP)
    prefix = (F.length("q") >= PREFIX_LENGTH) & (F.col("label").startswith(F.col("q")) | F.col("q").startswith(F.col("label")))
    token_hits = hit(pairs.where(prefix), 4).unionByName(hit(pairs, 5, F.col("j")))
    hits = equal.unionByName(token_hits)
    if near:
        left = open_.join(token_hits.select("text", "field").distinct(), ["text", "field"], "left_anti").where(F.length("q") >= NEAR_LENGTH)
        hits = hits.unionByName(hit(near_pairs(left, o, NEAR), 6, F.col("ratio")))
    return q.select("text", "field").join(best_rank(hits, ["text", "field"]), ["text", "field"], "left").select("text", "field", "iri", "label", "pass", "score")


def near_pairs(q: DataFrame, o: DataFrame, least: float) -> DataFrame:
    """Pairs of texts and labels whose matching-block ratio reaches ``least``.

    Texts of ratio r share most trigrams: with at most d = (1 - r)(la + lb) / 2
    letters on a side that don't match, at least one of d + 1 pieces of the
    shorter text stands unchanged in the other, so pairs are joined on their
    trigrams, counted, and bounded by length before the UDF.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    left = q.withColumn("g", F.explode(grams(F.col("q"))))
    right = o.withColumn("g", F.explode(grams(F.col("label"))))
    bound = F.least(F.length("q"), F.length("label")) * 2.0 / (F.length("q") + F.length("label")) >= least
    keys = ["text", "field", "q", "space", "label", "iri", "ord"]
    common = left.join(right, "g").where(bound).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Every letter out of place breaks at most three trigrams.
    slack = 3 * F.ceil((1 - least) * (F.length("q") + F.length("label")) / 2) + 3
    close = common.where((F.col("n") >= F.greatest(F.lit(1), F.least(F.length("q"), F.length("label")) - 2 - slack)) & (ratio_bound(F.col("q"), F.col("label")) >= least))
    return close.withColumn("ratio", sequence_ratio(F.col("q"), F.col("label"))).where(F.col("ratio") >= least)


def map_vocabulary(queries: DataFrame, index: DataFrame, synonyms: DataFrame, custom: DataFrame | None = None, min_len: int = 3, near: bool = True) -> DataFrame:
    """MT2. (category, field, text, iri, pass) of distinct values: custom mapping, exact, synonym, substring either way, ratio from 0.90.

    ``custom``: (category, field, q, iri), what was mapped before or by hand. A
    substring has to be at least ``min_len`` long; of several labels the first
    in order has it. Substring pairs are joined on the words they share at their
    ends and verified; a value inside one word of a label is found by its trigrams.
    """
    q = queries.select("category", "field", "text").distinct().withColumn("q", normalize(F.col("text"))).where("q is not null and q <> ''")
    o = deduplicated(index).where("space in ('class', 'individual')")
    syn = synonyms.groupBy("syn_norm").agg(F.max_by("canonical", "ord").alias("canonical")).select("syn_norm", normalize(F.col("canonical")).alias("label"))
    keys = ["category", "field", "text"]
    placed = lambda df: df.withColumn("space_ord", space_order(F.col("field"), F.col("space"), strict=False))
    cols = [*keys, "iri", "label", "pass", "score", "space_ord", "ord"]
    hit = lambda df, n, score=F.lit(1.0): placed(df).withColumns({"pass": F.lit(n), "score": score}).select(*cols)
    hits = hit(q.join(o, q["q"] == o["label"]), 1).unionByName(hit(q.join(syn, q["q"] == syn["syn_norm"]).drop("syn_norm").join(o, "label"), 2))
    if custom is not None:
        own = q.join(custom.select("category", "field", "q", "iri").distinct(), ["category", "field", "q"])
        hits = hits.unionByName(own.select(*keys, "iri", F.col("q").alias("label"), F.lit(0).alias("pass"), F.lit(1.0).alias("score"), F.lit(0).alias("space_ord"), F.lit(0).cast("long").alias("ord")))
    open_ = q.join(hits.select(*keys).distinct(), keys, "left_anti")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (min_len - 1)), lambda i: F.substring(c, i, F.lit(min_len)))
    long_q, long_o = open_.where(F.length("q") >= min_len), o.where(F.length("label") >= min_len)
    # The shorter text's first piece has to stand somewhere in the longer one.
    in_label = long_q.withColumn("g", F.substring("q", 1, min_len)).join(long_o.withColumn("g", F.explode(F.array_distinct(grams(F.col("label"))))), "g").where(F.col("label").contains(F.col("q")))
    in_query = long_q.withColumn("g", F.explode(F.array_distinct(grams(F.col("q"))))).join(long_o.withColumn("g", F.substring("label", 1, min_len)), "g").where(F.col("q").contains(F.col("label")))
    part = hit(in_label.drop("g").unionByName(in_query.drop("g")), 3)
    if not near:
        return q.select(*keys).join(best_rank(hits.unionByName(part), keys), keys, "left").select(*keys, "iri", "label", "pass", "score")
    left = open_.join(part.select(*keys).distinct(), keys, "left_anti")
    fuzzy = near_pairs(left.withColumns({"field": F.struct("category", "field")}), o, NEAR_LOOSE)
    fuzzy = fuzzy.withColumns({"category": F.col("field.category"), "field": F.col("field.field")})
    hits = hits.unionByName(part).unionByName(hit(fuzzy, 4, F.col("ratio")))
    return q.select(*keys).join(best_rank(hits, keys), keys, "left").select(*keys, "iri", "label", "pass", "score")
