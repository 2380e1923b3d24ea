"""Reconciliation of a table of terms: pending rows, scored and ranked suggestions, best match, export (F1-F8, T1-T5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.text import levenshtein_similarity, strip

NO_MATCH = "No Match"
#: The columns of a matching table.
REQUIRED = ("term", "uri", "rdf_role", "match_type")
ADDED = ("source_provider", "provider_term", "provider_description", "confirmed_display_string")


def prepared(df: DataFrame) -> DataFrame:
    """F2. Missing columns added, nulls as '', the uri as text; a missing required column is an error."""
    lacking = [c for c in REQUIRED if c not in df.columns]
    if lacking:
        raise ValueError(f"matching table lacks {', '.join(lacking)}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in (*REQUIRED, *ADDED)})


def is_pending(uri: Column) -> Column:
    """F1. No uri, or the mark of no match."""
    return F.coalesce(uri, F.lit("")).isin("", NO_MATCH)


def is_unreconciled(uri: Column, match_type: Column, skos: bool = True) -> Column:
    """F5. Pending, or (for vocabularies) without a match type."""
    return is_pending(uri) | (F.coalesce(match_type, F.lit("")) == "") if skos else is_pending(uri)


def with_suggestions(terms: DataFrame, suggestions: DataFrame, provider: str | None = None) -> DataFrame:
    """F4. Terms that have suggestions, of one provider or of any: a semi-join."""
    side = suggestions if provider is None else suggestions.where(F.col("provider") == provider)
    return terms.join(side.select("term_id").distinct(), "term_id", "left_semi")


def in_ontologies(suggestions: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """F6. Suggestions of the chosen ontologies, upper and lower case alike; none chosen keeps all."""
    if not chosen:
        return suggestions
    return suggestions.where(F.upper(F.coalesce(F.nullif(F.col("ontology"), F.lit("")), F.col("source_provider"))).isin(*[c.upper() for c in chosen]))


def well_formed(suggestions: DataFrame) -> DataFrame:
    """F7. With a label and a uri."""
    return suggestions.where("label is not null and uri is not null")


def scored(terms: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions with their term and the edit similarity of term and label; a blank term has none."""
    asked = terms.select("term_id", "term").where(strip(F.col("term")) != "")
    return suggestions.join(asked, "term_id").withColumn("levenshtein_score", levenshtein_similarity(strip(F.col("term")), F.col("label")))


def ranked(suggestions: DataFrame, key: Column, n: int, group: str = "term_id") -> DataFrame:
    """T1. The ``n`` best of each term by ``key`` (null or NaN counts as -1), ties by provider, then rank at the provider, then id.

    The planner limits each group before the shuffle, so a hot term sends few rows.
    """
    value = F.when(key.isNull() | F.isnan(key), -1.0).otherwise(key)
    order = Window.partitionBy(group).orderBy(value.desc(), "provider_ord", "api_rank", "suggestion_id")
    return suggestions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def local_matches(suggestions: DataFrame, least: float = 0.6, n: int = 10) -> DataFrame:
    """T2. Scores above ``least``, then the best ``n`` of each term (scored before it is limited)."""
    return ranked(suggestions.where(F.col("levenshtein_score") > least), F.col("levenshtein_score"), n)


def best_match(terms: DataFrame, suggestions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """T3/T4. Pending terms get their best suggestion from ``threshold`` on, else 'No Match' and blank fields; other terms stay.

    The source is the suggestion's source, database or ontology, else 'Unknown'; a uri without match type gets skos:exactMatch.
    """
    base = prepared(terms)
    open_ = base.where(is_pending(F.col("uri")))
    top = ranked(well_formed(scored(open_, suggestions)), F.col("levenshtein_score"), 1)
    found = top.where(F.col("levenshtein_score") >= threshold).select(
        "term_id", F.col("uri").alias("__uri"), F.col("label").alias("__label"), F.coalesce(F.col("description"), F.lit("")).alias("__description"),
        F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("source_provider", "db", "ontology")), F.lit("Unknown")).alias("__source"), F.col("levenshtein_score").alias("__score"),
    )
    joined = base.join(found, "term_id", "left")
    pending = is_pending(F.col("uri"))
    pick = lambda new, old, blank="": F.when(pending, F.coalesce(new, F.lit(blank))).otherwise(F.col(old))
    filled = joined.withColumns(
        {
            "provider_term": pick(F.col("__label"), "provider_term"), "provider_description": pick(F.col("__description"), "provider_description"),
            "source_provider": pick(F.col("__source"), "source_provider"), "score": F.col("__score"), "uri": pick(F.col("__uri"), "uri", NO_MATCH),
        }
    )
    typed = F.when(~is_pending(F.col("uri")) & (F.col("match_type") == ""), "skos:exactMatch").otherwise(F.col("match_type"))
    return filled.withColumn("match_type", typed).drop("__uri", "__label", "__description", "__source", "__score")


def export(df: DataFrame) -> DataFrame:
    """F8. The columns that are exported, in order, where present; the mark of no match becomes ''."""
    order = ("term", "uri", "rdf_role", "match_type", "source_provider", "provider_term", "provider_description")
    return df.select(*(F.when(F.col(c) == NO_MATCH, "").otherwise(F.col(c)).alias(c) if c == "uri" else F.col(c) for c in order if c in df.columns))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """T5. Page ``number`` (from 1; beyond the last it is the last) of rows in order."""
    count = df.count()
    last = max(1, -(-count // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)
