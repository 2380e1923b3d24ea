import difflib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semloom.functions import text as T


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c.alias("r")).first()["r"]


def test_levenshtein(spark):
    a, b = F.col("a"), F.col("b")
    s = T.levenshtein_similarity(a, b)
    assert one(spark, s, a="", b="") == 1 and one(spark, s, a="Abc", b="aBc") == 1 and one(spark, s, a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    df = spark.createDataFrame([(None, "x", 0.0), ("a😀b", "ab", 2 / 3)], "a string, b string, w double")
    for r in df.withColumn("s", s).collect():
        assert r["s"] == pytest.approx(r["w"])
    words = ["tomato", "tomatoe", "potato", "", "tomahawk"]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words], "a string, b string")
    for least in (0.5, 0.7, 0.85, 1.0):
        assert pairs.where(T.levenshtein_at_least(a, b, least) != (s >= least)).count() == 0


def test_sequence_ratio_is_difflib(spark):
    rows = [("abcd", "bcde"), ("", ""), ("celsius", "degree celsius"), ("a" * 300, "a" * 299 + "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", T.sequence_ratio("a", "b").alias("r"), T.ratio_bound(F.col("a"), F.col("b")).alias("m")).collect():
        want = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["r"] == pytest.approx(want) and r["m"] >= want - 1e-9


def test_normalize(spark):
    rows = ["  A  B\n", "ﬁne Ⅷ", "plain  text", "É"]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "a string")
    for r in df.select("a", T.normalize(F.col("a")).alias("n")).collect():
        assert r["n"] == (None if r["a"] is None else " ".join(unicodedata.normalize("NFKC", r["a"]).split()).lower())


@pytest.mark.parametrize("text,want", [("a b/c@d.e!", "a_b_c_at_d_e"), ("(x)  50%", "x_50_percent"), ("", ""), ("_" * 5, ""), ("a" * 150, "a" * 100), ("m&m's \"q\"", "m_and_ms_q")])
def test_sanitize(spark, text, want):
    assert one(spark, T.sanitize_iri(F.col("a")), a=text) == want


def test_small_functions(spark):
    assert one(spark, T.slugify(F.col("a")), a=" Ünï (code) -- Test ") == "ünï-code-test"
    assert one(spark, T.local_name(F.col("a")), a="http://x/y#z") == "z"
    assert one(spark, T.uri_namespace(F.col("a")), a="http://x/y/z") == "http://x/y" and one(spark, T.uri_namespace(F.col("a")), a="plain") == ""
    assert one(spark, T.comma_list(F.col("a")), a=" a,,b ,") == ["a", "b"]
    assert one(spark, T.turtle_literal(F.col("a"), F.lit("en")), a='x "y"') == '"""x \\"y\\""""@en'
    assert one(spark, T.turtle_iri(F.col("a"), {"ex": "http://x/"}), a="http://x/y") == "ex:y" and one(spark, T.turtle_iri(F.col("a"), {"ex": "http://x/"}), a="http://x/y?z") == "<http://x/y?z>"
    assert one(spark, T.suggestion_display(F.lit("L"), F.lit("S"), F.lit(0.871), F.lit("d" * 101), F.lit(None).cast("string"))) == f"L [S] [Lev: 0.87] ({'d' * 100}...) <No URI>"
    assert one(spark, T.core_iri("http://b/", F.col("a")), a="/m 1") == "http://b/m_1" and one(spark, T.core_iri("http://b/", F.col("a")), a="https://z") == "https://z"
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert one(spark, T.path_tail(F.col("a")), a="https://d/ontologies/FOO") == "FOO"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_and_slugify_are_idempotent(spark, texts):
    df = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "a string")
    n = T.normalize(F.col("a"))
    once = df.select(n.alias("a")).cache()
    assert once.where(~T.normalize(F.col("a")).eqNullSafe(F.col("a"))).count() == 0
