"""Suggestions of providers: recorded responses mapped to one schema, fan-out with a status per provider, connectors (P1-P14).

A response is recorded as (term, provider, status, body); body is the JSON text
that the service gave. A live connector is a function of a term that is run for
the terms of a partition with a pause between requests; what it raises becomes
an error row, so one provider's failure doesn't stop the others.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.functions.text import ncbi_uri, path_tail

FIELDS = ("uri", "label", "description", "ontology", "source_provider", "db", "id")
#: Seconds between the requests at a provider.
PAUSE = {"wikidata": 0.05, "ncbi": 0.34, "bioportal": 1.0, "ols": 0.5, "semlookp": 0.05}


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _first(v: Column, path: str) -> Column:
    """A text, or the first of a list of texts."""
    return F.coalesce(_get(v, f"{path}[0]"), F.when(F.try_variant_get(v, path, "array<variant>").isNull(), _get(v, path)))


def _wikidata(v: Column) -> dict[str, Column]:
    ident = _get(v, "$.id")
    return {"uri": F.coalesce(_get(v, "$.concepturi"), F.concat(F.lit("http://www.wikidata.org/entity/"), ident)), "label": F.coalesce(_get(v, "$.label"), F.lit("N/A")), "description": _get(v, "$.description"), "id": ident, "source_provider": F.lit("Wikidata")}


def _portal(v: Column) -> dict[str, Column]:
    return {"uri": _get(v, '$["@id"]'), "label": _get(v, "$.prefLabel"), "description": _first(v, "$.definition"), "ontology": path_tail(_get(v, "$.links.ontology"))}


def _ols(v: Column) -> dict[str, Column]:
    return {"uri": _get(v, "$.iri"), "label": _get(v, "$.label"), "description": _first(v, "$.description"), "ontology": _get(v, "$.ontology_name"), "source_provider": _get(v, "$.ontology_prefix")}


def _semlookp(v: Column) -> dict[str, Column]:
    return {**_ols(v), "source_provider": F.coalesce(_get(v, "$.ontology_prefix"), _get(v, "$.ontology_name"), F.lit("SemLookP"))}


def _geonames(v: Column) -> dict[str, Column]:
    parts = F.concat_ws(", ", *(F.nullif(_get(v, f"$.{k}"), F.lit("")) for k in ("fcodeName", "adminName1", "countryName")))
    ident = _get(v, "$.geonameId")
    return {"uri": F.concat(F.lit("https://sws.geonames.org/"), ident, F.lit("/")), "label": _get(v, "$.name"), "description": parts, "id": ident, "source_provider": F.lit("GeoNames")}


def _binding(v: Column) -> dict[str, Column]:
    value = lambda k: _get(v, f"$.{k}.value")
    return {"uri": F.coalesce(value("uri"), value("concept")), "label": F.coalesce(value("label"), value("prefLabel")), "description": F.coalesce(value("description"), value("definition"), value("scopeNote"))}


def _ncbi(v: Column) -> dict[str, Column]:
    db = _get(v, "$.db")
    label = {"taxonomy": "scientificname", "bioproject": "name", "gene": "name", "biosample": "accession"}
    text = {"taxonomy": "rank", "bioproject": "project_description", "protein": "organism", "nuccore": "organism"}
    pick = lambda m, default: F.coalesce(*(F.when(db == k, _get(v, f"$.{f}")) for k, f in m.items()), F.when(~db.isin(*m), _get(v, f"$.{default}")))
    uid = _get(v, "$.uid")
    ident = F.coalesce(F.when(db == "bioproject", _get(v, "$.project_acc")), F.when(db == "biosample", _get(v, "$.accession")), uid)
    date = F.when(_get(v, "$.pubdate") != "", F.concat(F.lit(" ("), _get(v, "$.pubdate"), F.lit(")")))
    pubmed = F.when(db == "pubmed", F.concat(F.coalesce(_get(v, "$.authors[0].name"), F.lit("")), F.coalesce(date, F.lit(""))))
    return {"uri": ncbi_uri(db, ident), "label": F.coalesce(pick(label, "title"), F.concat(F.lit("Unknown "), db, F.lit(" "), uid)), "description": F.coalesce(pubmed, pick(text, "description"), _get(v, "$.summary"), F.lit("")), "db": db, "id": ident, "source_provider": F.concat(F.lit("NCBI "), db)}


#: Of each provider: where its list of items stands in a response, and how an item is read.
PROVIDERS: Mapping[str, tuple[str, Callable[[Column], dict[str, Column]]]] = {
    "wikidata": ("$.search", _wikidata), "ncbi": ("$.items", _ncbi), "bioportal": ("$.collection", _portal), "agroportal": ("$.collection", _portal), "earthportal": ("$.collection", _portal),
    "ols": ("$.response.docs", _ols), "semlookp": ("$.response.docs", _semlookp), "qudt": ("$.results.bindings", _binding), "custom": ("$.results.bindings", _binding), "agrovoc": ("$.results.bindings", _binding), "geonames": ("$.geonames", _geonames),
}


def suggestions(responses: DataFrame, order: Sequence[str] = tuple(PROVIDERS)) -> DataFrame:
    """(term, provider, provider_ord, api_rank, uri, label, description, ...) of recorded responses that are no error.

    A body that can't be read, an unknown provider or an empty list gives no row; rank is the place in the list.
    """
    out = None
    for name, (path, read) in PROVIDERS.items():
        rows = responses.where((F.col("provider") == name) & (F.coalesce("status", F.lit("completed")) == "completed")).select("term", F.try_parse_json("body").alias("b"))
        items = rows.select("term", F.posexplode(F.try_variant_get("b", path, "array<variant>")).alias("i", "v"))
        fields = read(F.col("v"))
        part = items.select("term", F.lit(name).alias("provider"), F.lit(order.index(name) if name in order else len(order)).alias("provider_ord"), (F.col("i") + 1).alias("api_rank"), *(fields.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("source_provider", F.coalesce("source_provider", F.upper("ontology"), "provider"))


def fan_out(terms: DataFrame, connectors: Mapping[str, Callable[[str], str]], parallel: int = 4) -> DataFrame:
    """J-multi. (term, provider, status, error, body): every distinct non-blank term asked at every connector, each provider in ``parallel`` tasks that together keep its pause."""
    out = None
    asked = terms.select("term").where("trim(term) <> ''").distinct()
    for name, ask in connectors.items():

        def run(batches: Iterator[pd.DataFrame], name=name, ask=ask) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for term in b["term"]:
                    try:
                        rows.append((term, name, "completed", None, ask(term)))
                    except Exception as e:
                        rows.append((term, name, "error", str(e)[:200], None))
                    time.sleep(PAUSE.get(name, 0.0) * parallel)
                yield pd.DataFrame(rows, columns=["term", "provider", "status", "error", "body"])

        part = asked.repartition(parallel, "term").mapInPandas(run, "term string, provider string, status string, error string, body string")
        out = part if out is None else out.unionByName(part)
    return out


def provider_status(responses: DataFrame) -> DataFrame:
    """M14. (provider, status, terms): 'error' where any term failed, else 'completed'."""
    return responses.groupBy("provider").agg(F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("completed").alias("status"), F.count(F.lit(1)).alias("terms"))


def catalogue_order(options: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """P13/P14. Distinct upper-cased names: the preferred ones in their order, then the rest by name."""
    place = F.nullif(F.array_position(F.array(*(F.lit(p.upper()) for p in preferred)), F.col("name")), F.lit(0))
    return options.select(F.upper("name").alias("name")).distinct().orderBy(place.asc_nulls_last(), "name")


def fill_template(template: str, term: str, limit: int) -> str:
    """P9/Q25. A query template with {term} and {limit} filled ({{ and }} stand for braces); quotes and backslashes of the term are escaped."""
    safe = term.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'")
    return template.format(term=safe, limit=limit)
