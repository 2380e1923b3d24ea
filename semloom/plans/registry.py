"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from semloom.plans import files, graph, nested, packed_units, reconcile, skos_climate

MODULES = (packed_units, reconcile, graph, skos_climate, nested, files)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "t3_best_match"
