"""The IRIs that graph operators look for: full, as readers load them, and one argument that a user may replace."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Public namespaces.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dct": "http://purl.org/dc/terms/",
    "schema": "https://schema.org/",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "prov": "http://www.w3.org/ns/prov#",
}
#: Names of the mapping properties, in their order.
MATCH_NAMES = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


def iri(curie: str) -> str:
    """The full IRI of a CURIE whose prefix is public."""
    prefix, name = curie.split(":", 1)
    return NAMESPACES[prefix] + name


@dataclass(frozen=True)
class Vocabulary:
    """Terms of public vocabularies, and of the vocabulary that describes models, which differs from graph to graph.

    ``has_parameter`` and ``identifier`` are paths from the model (one step or more).
    """

    type: str = iri("rdf:type")
    concept: str = iri("skos:Concept")
    concept_scheme: str = iri("skos:ConceptScheme")
    in_scheme: str = iri("skos:inScheme")
    pref_label: str = iri("skos:prefLabel")
    alt_label: str = iri("skos:altLabel")
    definition: str = iri("skos:definition")
    rdfs_label: str = iri("rdfs:label")
    title: str = iri("dct:title")
    description: str = iri("dct:description")
    source: str = iri("dct:source")
    has_part: str = iri("dct:hasPart")
    informed_by: str = iri("prov:wasInformedBy")
    label: str = iri("schema:label")
    name: str = iri("schema:name")
    has_geometry: str = iri("geo:hasGeometry")
    as_wkt: str = iri("geo:asWKT")
    level: str = ""
    model: str = ""
    composite: str = ""
    has_scope: str = ""
    product: str = ""
    hazard: str = ""
    has_parameter: tuple[str, ...] = ()
    identifier: tuple[str, ...] = (iri("schema:identifier"),)
    param_id: str = ""
    unit: str = ""
    classification: str = ""
    variable_name: str = ""

    @classmethod
    def of(cls, base: str, **terms) -> Vocabulary:
        """With the terms of models under ``base``, by the names used here unless ``terms`` gives them."""
        own = {
            "level": base + "level", "model": base + "Model", "composite": base + "CompositeModel", "has_scope": base + "hasScope", "product": base + "product", "hazard": base + "hazard",
            "has_parameter": (base + "hasParameter",), "param_id": base + "paramId", "unit": base + "unit", "classification": base + "classification", "variable_name": base + "sourceVariableName",
        }
        return replace(cls(), **{**own, **terms})

    @property
    def matches(self) -> tuple[str, ...]:
        return tuple(iri(f"skos:{m}") for m in MATCH_NAMES)
