import difflib

import duckdb

from semloom.plans import registry


def test_all_providers_and_texts(spark, data):
    """Brute force over every suggestion with a uri."""
    read = lambda q: duckdb.sql(q.replace("FROM ", f"from '{data}/")).fetchall()
    mapping, terms, cands = {}, {}, {}
    for term, alts, provider in read("select term, altlabels, providerterm1 FROM master_mapping.parquet' where term is not null order by row_id"):
        mapping.setdefault(term, (alts, provider))
    for i, term, provider in read("select term_id, term, provider_term FROM matching_table_for_reconciliation.parquet'"):
        alts, other = mapping.get(term, (None, None))
        terms[i] = [x.lower() for x in (term, alts, provider or other) if x]
    for i, uri, label, ident in read("select term_id, uri, label, id FROM suggestion.parquet' where uri <> '' order by suggestion_id"):
        if i in terms:
            c = cands.setdefault(i, {}).setdefault(uri, (set(), []))
            c[0].update([label] if label is not None else [])
            c[1].extend([ident] if ident else [])
    want = {}
    for i, uris in cands.items():
        best = -1
        for uri, (labels, ids) in uris.items():
            name = uri.split("/")[-1]
            targets = [t.lower() for t in (*labels, name, min(ids, default=name)) if t]
            score = sum((50 if t in s or s in t else 0) + (20 if difflib.SequenceMatcher(None, s, t).ratio() > 0.6 else 0) for s in terms[i] for t in targets)
            if score > best:
                best, want[f"param:{i}"] = score, (uri, uri.split("/")[-1])
    rows = registry.QUERIES["mt5_wire"](spark, data).collect()
    by = lambda p: {r["s"]: r["o"] for r in rows if r["p"].endswith(p)}
    source, variable = by("isFulfilledBy"), by("sourceVariableName")
    got = {o: (source[s], variable[s]) for s, o in by("mapsParameter").items()}
    providers = dict(read("select term_id, count(*) filter (provider = 'olx') FROM suggestion.parquet' where uri <> '' group by 1"))
    assert got == want and any(not n for n in providers.values())
