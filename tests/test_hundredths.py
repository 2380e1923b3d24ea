import random

from pyspark.sql import functions as F

from semloom.functions.text import hundredths
from semloom.plans import registry


def test_as_python_rounds(spark):
    rng = random.Random(3)
    values = [k / 1000 for k in range(-1500, 1500)] + [k / 8 for k in range(-40, 4000)] + [rng.random() * 10 ** rng.randrange(-3, 8) for _ in range(2000)] + [-0.0, -0.001, 0.125, 0.375, 0.285, 2.675, 1e9, 123456789.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", hundredths(F.col("v")).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in got if r["t"] != f"{r['v']:.2f}"] == []


def test_every_suggestion_is_shown(spark, data):
    scores = {r["suggestion_id"]: r["score"] for r in spark.read.parquet(f"{data}/suggestion.parquet").collect()}
    shown = {r["suggestion_id"]: r["display"] for r in registry.QUERIES["x17_suggestion_display"](spark, data).collect()}
    assert shown.keys() == scores.keys()
    assert all(s is None or s != s or f"[Lev: {s:.2f}]" in shown[i] for i, s in scores.items())
