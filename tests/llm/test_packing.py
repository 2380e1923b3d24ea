import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semloom.llm.packing import best_fit, certificate, lower_bound, pack, token_sizes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_bound_and_fit(sizes):
    x = np.array(sizes)
    bins, offset = best_fit(x, 100)
    used = np.bincount(bins, weights=x)
    assert used.max() <= 100 and lower_bound(x, 100) <= len(used) <= 2 * lower_bound(x, 100)
    for b in range(len(used)):
        mine = sorted((offset[i], x[i]) for i in range(len(x)) if bins[i] == b)
        at = 0
        for o, n in mine:
            assert o == at
            at += n


def test_bound_sees_halves():
    assert lower_bound(np.array([51] * 10), 100) == 10 and lower_bound(np.array([34] * 9), 100) == 5 and lower_bound(np.array([], dtype=int), 100) == 0


def check(rows, sizes, capacity):
    held = {}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["id"], []).append((r["piece"], r["start"], r["n"]))
        if r["container"] is not None:
            held.setdefault(r["container"], []).append((r["place"], r["offset"], r["n"]))
    for i, n in sizes.items():
        got = sorted(pieces[i])
        assert sum(p[2] for p in got) == n and [p[0] for p in got] == [*range(len(got))]
        assert len(got) == max(1, -(-n // capacity)), "only what exceeds the capacity is cut"
    for c in held.values():
        at = 0
        for k, (place, offset, n) in enumerate(sorted(c), 1):
            assert place == k and offset == at
            at += n
        assert at <= capacity
    return len(held)


def test_rounds_and_cases(spark):
    rng = np.random.default_rng(5)
    sizes = {int(i): int(n) for i, n in enumerate(rng.integers(0, 3000, 3000))} | {5000: 0, 5001: 2048, 5002: 4096, 5003: 70_000}
    df = spark.createDataFrame([(i, n, "c") for i, n in sizes.items()], "id long, n long, container string")
    for pieces in (50_000, 300):
        packed = pack(df, 2048, pieces=pieces)
        count = check(packed.collect(), sizes, 2048)
        c = certificate(packed).first()
        assert c["containers"] == count and c["bound"] <= count <= c["bound"] * 1.02 + 2
    assert pack(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 5)], "id long, n long")
    assert [r["container"] for r in pack(nulls).collect()] == [None, None]


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 50_000)], "doc_id long, text string")
    got = {r["id"]: r["n"] for r in token_sizes(df, "doc_id", "text", P.path("byte_bpe_50k.json")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 50_000
    assert token_sizes(df.where(F.lit(False)), "doc_id", "text", P.path("byte_bpe_50k.json")).count() == 0
