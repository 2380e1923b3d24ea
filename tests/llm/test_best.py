from datetime import datetime
from itertools import product

from pyspark.sql import functions as F

from semloom.llm.best import best_records, completeness, concept_of, skyline_layers, survivors
from semloom.llm.queries import FIELDS
from semloom.session import col

SCHEMA = "suggestion_id long, term_id long, provider_ord int, uri string, id string, label string, description string, source_provider string, retrieved_at timestamp, layer int, group_id string"


def layers(df, hot=20_000):
    return skyline_layers(df, {"term_id": col("term_id"), "concept": concept_of(col("uri"), col("id"))}, "suggestion_id", FIELDS, "retrieved_at", "provider_ord", cut=["description"], hot=hot)


def rank(v, cut=False):
    t = "" if v is None else v.strip()
    return 0 if t in ("", "-") or t.lower() == "n/a" else 1 if cut and t.endswith(("…", "...")) else 2


def brute(rows):
    groups = {}
    for r in rows:
        uri = (r[3] or "").strip()
        concept = uri.rstrip("/").rsplit("/", 1)[-1] if rank(uri) else (r[4] or None)
        if concept and r[1] is not None:
            groups.setdefault((r[1], concept), []).append(r)
    out = set()
    for g in groups.values():
        v = {r[0]: (rank(r[3]), rank(r[5]), rank(r[6], True), rank(r[7]), r[8] or datetime(1, 1, 1), -(r[2] if r[2] is not None else 2**31 - 1)) for r in g}
        if len(g) > 1:
            ok = [i for i, x in v.items() if all(all(a >= b for a, b in zip(x, y)) for y in v.values())]
            if ok:
                out.add((min(v), min(ok)))
    return out


def test_against_brute_force(spark):
    texts = [None, "", "N/A", "label"]
    descriptions = [None, "-", "cut off…", "whole"]
    times = [None, datetime(2024, 1, 1), datetime(2024, 5, 1)]
    rows = []
    for i, (a, d, t, p) in enumerate(product(texts, descriptions, times, [0, 3, None])):
        rows.append((i, i % 23, p, "http://x/c1" if i % 5 else None, "c1", a, d, texts[(i * 7) % 4], t, 1, "clash"))
    rows.append((9999, None, 0, "http://x/c1", None, "a", "b", "c", None, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["group_id"], r["survivor_id"]) for r in survivors(layers(df)).collect()}
    assert got == brute(rows)
    assert {(r["group_id"], r["survivor_id"]) for r in survivors(layers(df.repartition(7))).collect()} == got
    # Some groups, or all, reduced before the shuffle give the same.
    assert all({(r["group_id"], r["survivor_id"]) for r in survivors(layers(df, hot=n)).collect()} == got for n in (0, 5))


def test_hot_group_ties_and_fill(spark):
    hot = spark.range(20_000).select(
        (F.col("id") + 10).alias("suggestion_id"), F.lit(1).cast("long").alias("term_id"), (F.col("id") % 3).cast("int").alias("provider_ord"), F.lit("http://x/c").alias("uri"), F.lit(None).cast("string").alias("id"),
        F.lit("-").alias("label"), F.concat(F.lit("d"), "id").alias("description"), F.lit("S").alias("source_provider"), F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"),
    )
    old = spark.createDataFrame([(1, 1, 9, "HTTP://X/c/", None, "the label", None, None, datetime(2020, 1, 1), 1, "")], SCHEMA).select(*hot.columns)
    df = hot.unionByName(old)
    out = layers(df).collect()
    assert len(out) == 1 and out[0]["n_rows"] == 20_001 and out[0]["group_id"] == 1
    best = best_records(layers(df), df, "suggestion_id", ["term_id", "concept"], FIELDS).first()
    # The policy asks for the label before the description; what that row lacks comes from the others.
    assert best["survivor_id"] == 1 and best["best_label"] == "the label" and best["best_description"] == "d0"
    assert survivors(layers(df)).count() == 0
    # Without the row that alone has a label the first of the equal best rows survives.
    assert [tuple(r) for r in survivors(layers(hot)).collect()] == [(10, 10)]


def test_helpers_and_empty(spark):
    df = spark.createDataFrame([("https://h.example/class/A%5F1?x=1", "A_1"), (" http://H/class/A_1/ ", "A_1"), (None, "A_1"), ("", None), ("N/A", "Z")], "u string, w string")
    assert [r["c"] for r in df.select(concept_of(F.col("u"), F.col("w")).alias("c")).collect()] == ["A_1", "A_1", "A_1", None, "Z"]
    long_ = spark.createDataFrame([("x" * 300_000 + "...",)], "d string")
    assert long_.select(completeness(F.col("d"), True).alias("c")).first()["c"] == 1
    assert layers(spark.createDataFrame([], SCHEMA)).count() == 0
