"""Queries over every row, also where their SQL holds to a part: brute force in Python."""

import math
import re

import duckdb
import pytest

from semloom.plans import registry


def run(spark, folder, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, folder).collect()]


@pytest.fixture(scope="module")
def read(data):
    def rows(table):
        r = duckdb.sql(f"select * from '{data}/{table}.parquet'")
        return [dict(zip(r.columns, x)) for x in r.fetchall()]

    return rows


def similarity(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


@pytest.fixture(scope="module")
def scored(read):
    """(term row, suggestion, similarity) of all suggestions with a label whose term isn't blank."""
    terms = {t["term_id"]: t for t in read("matching_table_for_reconciliation")}
    out = []
    for s in read("suggestion"):
        t = terms.get(s["term_id"])
        if t and s["label"] is not None and (t["term"] or "").strip():
            out.append((t, s, similarity(t["term"].strip(), s["label"])))
    return out


def pending(t):
    return (t["uri"] or "") in ("", "No Match")


def best(scored, least, n):
    groups = {}
    for t, s, v in scored:
        if pending(t) and s["uri"] is not None and v > least:
            groups.setdefault(t["term_id"], []).append((-v, s["provider_ord"], s["api_rank"], s["suggestion_id"], s))
    return {k: sorted(g, key=lambda x: x[:4])[:n] for k, g in groups.items()}


def odd(text):
    return text is not None and not text.isascii()


@pytest.mark.parametrize("name,least,n", [("t1_rank_levenshtein", -1, 10), ("t2_local_threshold", 0.6, 5)])
def test_ranks(spark, data, scored, name, least, n):
    want = {(k, x[3], i): -x[0] for k, g in best(scored, least, n).items() for i, x in enumerate(g, 1)}
    got = {(r["term_id"], r["suggestion_id"], r["rank"]): r["score"] for r in run(spark, data, name)}
    assert got == pytest.approx(want)
    assert any(odd(t["term"]) or odd(s["label"]) for t, s, _ in scored if any((t["term_id"], s["suggestion_id"], i) in got for i in range(1, n + 1)))


def test_best_match(spark, data, read, scored):
    top, terms = best(scored, -1, 1), read("matching_table_for_reconciliation")
    got = {r["term_id"]: r for r in run(spark, data, "t3_best_match")}
    assert len(got) == len(terms) and any(odd(t["term"]) for t in terms)
    for t in terms:
        b = top.get(t["term_id"])
        uri, label = (t["uri"], t["provider_term"] or "") if not pending(t) else (b[0][4]["uri"], b[0][4]["label"]) if b and -b[0][0] >= 0.7 else ("No Match", "")
        assert (got[t["term_id"]]["uri"], got[t["term_id"]]["provider_term"]) == (uri, label), t


def test_hybrid(spark, data, scored, read):
    vectors = {r["vec_id"]: r["embedding"] for r in read("embeddings")}
    n = len(vectors)

    def cosine(a, b):
        x, y = vectors[a % n], vectors[b % n]
        norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
        return sum(v * w for v, w in zip(x, y)) / norm if norm else 0.0

    want = {s["suggestion_id"]: cosine(s["suggestion_id"], t["term_id"]) * 0.5 + cosine(s["suggestion_id"] + 7, t["term_id"]) * 0.2 + v * 0.3 for t, s, v in scored}
    assert {r["suggestion_id"]: r["score"] for r in run(spark, data, "x2_hybrid")} == pytest.approx(want, abs=2e-6)
    assert any(odd(t["term"]) for t, *_ in scored)


def words(text):
    return {w for w in text.lower().translate(str.maketrans("_-()[]/,.", " " * 9)).split() if len(w) > 2}


def overlap(a, b):
    return sum(1 if x == y else 0.8 if x in y or y in x else 0 for x in a for y in b)


def test_mappings(spark, data, read):
    m = read("master_mapping")
    assert any(odd(r["altlabels"]) for r in m)
    got = {r["row_id"]: r["display"] for r in run(spark, data, "x16_display_label")}
    assert got == {r["row_id"]: None if r["term"] is None else f"{r['term']} ({r['altlabels']})" if (r["altlabels"] or "").strip(" ") else r["term"] for r in m}
    got = {r["row_id"]: r["score"] for r in run(spark, data, "x8_keyword_overlap")}
    assert got == pytest.approx({r["row_id"]: overlap(words(r["term"]), words(r["altlabels"])) for r in m if r["term"] is not None and r["altlabels"] is not None}, abs=1e-5)


def test_names(spark, data, read):
    p = read("model_parameter")
    names = {r["name"] for r in p if r["name"] is not None}
    assert any(map(odd, names))
    blank = {n for n in names if not n.strip()}
    assert {r["text"] for r in run(spark, data, "mt1_cascade")} == names - blank
    properties = [(r["concept_id"], r["label"], words(r["label"])) for r in read("ontology_index") if r["space"] == "property"]
    want = {n: max(s for s, *_ in hits) for n in names if (hits := [(round(v, 6), i, x) for i, x, w in properties if (v := overlap(words(n), w)) > 0])}
    assert {r["text"]: r["score"] for r in run(spark, data, "x8_keyword_match")} == pytest.approx(want)
    sides = lambda c: {(r["model_id"], r["name"].lower()) for r in p if r["name"] is not None and (r["classification"] or "").upper() == c}
    want = {(f"model:{a}", f"model:{b}", n) for a, n in sides("OUTPUT") for b, k in sides("INPUT") if n == k and a != b}
    assert {(r["source"], r["target"], r["name"]) for r in run(spark, data, "q17_connections")} == want


def test_labels(spark, data, read):
    index = read("ontology_index")
    labels = {(r["iri"], r["label"]) for r in index} | {(i["iri"], y["syn_norm"]) for y in read("ontology_synonym") for i in index if i["label"] == y["canonical"]}
    terms = {r["term"] for r in read("master_mapping") if r["term"] is not None}
    assert {(r["text"], r["concept"]) for r in run(spark, data, "q21_match_by_label")} == {(t, s) for t in terms for s, x in labels if x is not None and x.lower() == t.lower()}
    want = set()
    for t in {r["term"] for r in read("matching_table_for_reconciliation") if (r["term"] or "").strip()}:
        hits = sorted({(x, s) for s, x in labels if x is not None and t.strip().lower() in x.lower()}, key=lambda h: (h[0].encode(), h[1].encode()))
        want |= {(t, s, x, i) for i, (x, s) in enumerate(hits[:10], 1)}
    assert {(r["term"], r["s"], r["label"], r["rank"]) for r in run(spark, data, "q1_concept_search")} == want


def test_every_odd_letter_of_a_label_is_searched(spark, tmp_path, data):
    import shutil

    for t in ("ontology_index", "ontology_synonym", "models", "model_parameter", "master_mapping"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path)
    label = duckdb.sql(f"select label from '{data}/ontology_index.parquet' limit 1").fetchall()[0][0]
    spark.createDataFrame([("\xa0" + label + "\u3000",), ("é",)], "term string").write.parquet(str(tmp_path / "matching_table_for_reconciliation.parquet"))
    assert re.sub(r"^\s+|\s+$", "", run(spark, str(tmp_path), "q1_concept_search")[0]["term"]) == label
