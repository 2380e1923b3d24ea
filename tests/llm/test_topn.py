import random

from pyspark.sql import functions as F

from semloom.llm import topn
from semloom.llm.topn import top_n

SCHEMA = "suggestion_id long, uri string, score double, source_provider string, place int, g string"


def brute(rows, n):
    groups = {}
    for i, u, s, p, *_ in rows:
        if u and s is not None and s == s:
            groups.setdefault(u, []).append((-s, p is None, (p or "").encode(), i))
    return {(x[3], k) for g in groups.values() for k, x in enumerate(sorted(g)[:n], 1)}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topn, "HOLD", 20)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " ", "hot", "hot", *"abcdefgh"]), rng.choice([None, float("nan"), 0.0, -0.0, 0.5, 1.0, float("inf")]), rng.choice([None, "", "é", "z", "A", "a"]), 9, "clash") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n in (1, 3):
        got = {(r["suggestion_id"], r["place"]) for r in top_n(df, "uri", "score", "source_provider", "suggestion_id", n).collect()}
        assert got == brute(rows, n)
    spark.conf.set(batch, before)


def test_long_texts_and_empty(spark):
    rows = [(1, "u" * 100_000, 1.0, "p", 1, ""), (2, "u" * 100_000, 1.0, None, 1, "")]
    out = top_n(spark.createDataFrame(rows, SCHEMA), "uri", "score", "source_provider", "suggestion_id", 3)
    assert sorted((r["suggestion_id"], r["place"]) for r in out.collect()) == [(1, 1), (2, 2)]
    assert top_n(spark.createDataFrame([], SCHEMA), "uri", "score", "source_provider", "suggestion_id", 3).count() == 0


def test_hot_group_sends_few_rows(spark):
    df = spark.range(100_000).select(F.col("id").alias("i"), F.lit("hot").alias("u"), F.rand(3).alias("s"), F.lit("p").alias("p"))
    assert top_n(df, "u", "s", "p", "i", 3).count() == 3
