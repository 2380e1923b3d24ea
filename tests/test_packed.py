import pytest
from pyspark.sql import functions as F

from semloom.operators.packed import split_packed

CASES = [
    ('"a; ""old"" b"; c;miller\'s d ', ['a; "old" b', "c", "miller's d"]),
    ('["a, b", "c \\"x\\" d", "it\'s"]', ["a, b", 'c "x" d', "it's"]),
    ("['a, b', 'c']", ["a, b", "c"]),
    ("'x';'x'", ["x", "x"]),
    ("venison\\, wholegrain, 3,9-acid", ["venison, wholegrain", "3,9-acid"]),
    ("mg/kg / w/w basis", ["mg/kg", "w/w basis"]),
    ("a, b|c", ["a, b", "c"]),
    ("a\r\n b, c \nd", ["a", "b, c", "d"]),
    ("a\tb", ["a", "b"]),
    ("一、二；三", ["一、二", "三"]),
    ("a，b、c", ["a", "b", "c"]),
    (" , ,", []),
    ('a;"";b', ["a", "b"]),
    ("[]", []),
    ("", []),
    ("   ", []),
    (None, []),
    ("one", ["one"]),
    ("a0b,cd", ["a0b", "cd"]),
    ('"open, b', ['"open', "b"]),
    ("'tis, x", ["'tis", "x"]),
]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "row_id long, altlabels string, val string, pos int")
    out = {}
    for r in split_packed(df, "altlabels", ["row_id"]).orderBy("row_id", "pos").collect():
        out.setdefault(r["row_id"], []).append(r["val"])
        assert r["pos"] == len(out[r["row_id"]])
    return out


def test_cases(spark):
    got = run(spark, [c[0] for c in CASES])
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, []) == want, text


def test_long_repeated_and_null_keys(spark):
    long_ = ";".join(f'"v{i}, ""q"""' for i in range(20_000))
    quotes = '"' * 50_001
    got = run(spark, [long_, long_, quotes])
    assert len(got[0]) == 20_000 and got[0] == got[1] and got[0][1] == 'v1, "q"'
    df = spark.createDataFrame([(None, "a,b")], "row_id long, altlabels string")
    assert [tuple(r) for r in split_packed(df, "altlabels", ["row_id"]).collect()] == [(None, 1, "a"), (None, 2, "b")]


def test_empty_table_and_schema(spark):
    df = spark.createDataFrame([], "row_id long, altlabels string")
    out = split_packed(df, "altlabels", ["row_id"])
    assert out.count() == 0 and out.dtypes == [("row_id", "bigint"), ("pos", "int"), ("val", "string")]


def test_no_shuffle_or_python(spark):
    df = spark.range(3).select("id", F.lit("a,b").alias("t"))
    plan = split_packed(df, "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
