import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from semloom.llm.tokens import encode_corpus, encoder

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "   ", "\n\n x", "don't we'll I'm they've he'd she's you're O'REILLY 'tis ''s x's  's", "a'restaurant 'll' '", "<|endoftext|> [INST]", "日本語テキスト、です。１２３", "🙂👨‍👩‍👧 é é", "\x00\x85 　 x y",
    "a" * 3000, "ab" * 1500, "=" * 700 + "-=" * 300, " " * 999, "x 12,345.67e-8\t\r\n", "Γεια σου مرحبا", "ſ K Å",
]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    ids, at, *_ = encoder(PATH).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_equal_to_exact(exact):
    assert ids_of(TEXTS) == [exact.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs", "Cn"])), st.text("aeinst' \n.lr1", max_size=60)), max_size=6))
def test_random_texts(exact, texts):
    assert ids_of(texts) == [exact.encode_ordinary(t) for t in texts]


def test_pair_check_decides_words():
    v = encoder(PATH).vocabulary
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("aeioustrnlgh") for _ in range(rng.randint(1, 14))).encode()
        g, x = v.greedy(word), v.exact(word)
        import numpy as np

        fine = len(g) < 2 or bool(v.compatible(np.array(g[:-1]), np.array(g[1:])).all())
        assert fine == (g == x), word


def test_frame(spark, exact):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(98, None, "c"), (99, TEXTS[4], "c"), (None, "x", "c")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "doc_id", "text", PATH).collect()}
    assert got[98] == [] and got[0] == [] and got[99] == got[4] and got[None] == exact.encode_ordinary("x")
    assert all(got[i] == exact.encode_ordinary(t) for i, t in enumerate(TEXTS))
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
