"""The finder on texts it wasn't fitted on: labelled by hand, and of the tables (texts that the trainer holds out)."""

import re
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from semloom.llm import pii
from semloom.llm.pii import KINDS, MODEL, Model, find, find_personal, masked, redact
from semloom.llm.pii_train import held_out, introduced_names, labels, towns

MARK = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "a": "street_address"}


@pytest.fixture(scope="module")
def model():
    return Model(MODEL)


def marked(line):
    out, spans = "", []
    for part in re.split(r"(\[[nepia]\|[^\]]*\])", line):
        if m := re.fullmatch(r"\[([nepia])\|([^\]]*)\]", part):
            spans.append((len(out), len(out) + len(m[2]), MARK[m[1]]))
            part = m[2]
        out += part
    return out, spans


def measured(pairs, model):
    """Recall and precision by kind."""
    found = find([t for t, _ in pairs], model)
    hit, want, got = Counter(), Counter(), Counter()
    for (_, spans), f in zip(pairs, found):
        want.update(k for *_, k in spans)
        got.update(k for *_, k in f)
        hit.update(k for *_, k in set(spans) & set(f))
    return {k: (hit[k] / max(1, want[k]), hit[k] / max(1, got[k])) for k in KINDS}


def test_by_hand(model):
    lines = [x for x in (Path(__file__).parent / "pii_hand.txt").read_text(encoding="utf-8").split("\n") if x and x[0] != "#"]
    got = measured([marked(x) for x in lines], model)
    assert len(lines) >= 100 and all(recall >= 0.85 and precision >= 0.85 for recall, precision in got.values()), got


def test_held_out_texts_of_the_tables(model, data):
    texts = pd.read_parquet(data.replace("0.001", "0.1") + "/documents.parquet")["text"].dropna().unique().tolist()
    (given, surnames), known = introduced_names(texts), towns(texts)
    pairs = []
    for t in [t for t in texts if held_out(t)]:
        found = pii.candidates(t)
        pairs.append((t, [(a, b, k) for (k, a, b, _), y in zip(found, labels(t, found, given, surnames, known)) if y]))
    got = measured(pairs, model)
    assert len(pairs) > 300 and all(recall >= 0.95 and precision >= 0.95 for recall, precision in got.values()), got


TEXT = "Samples were collected by Emre de Roovic at 39 Stoswick Street on 01/02/2020. Tel. 01632 960930, mail e.roovic@lab.example."


def test_rows_and_redaction(spark):
    long_ = TEXT + " nothing of note here." * 20_000 + " " + TEXT
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, TEXT, "x"), (6, long_, "x")], "doc_id long, text string, kind string")
    rows = {}
    for r in find_personal(df, "doc_id", "text").collect():
        rows.setdefault(r["doc_id"], set()).add((r["kind"], r["start_pos"], r["end_pos"]))
    assert set(rows) == {1, 5, 6} and rows[1] == rows[5] and len(rows[6]) == 2 * len(rows[1])
    assert {k for k, *_ in rows[1]} == {"person_name", "street_address", "phone", "email"}
    red = {r["doc_id"]: r["redacted"] for r in redact(df, "doc_id", "text").collect()}
    assert red[1] == "Samples were collected by [PERSON_NAME] at [STREET_ADDRESS] on 01/02/2020. Tel. [PHONE], mail [EMAIL]." and red[2] is None and red[3] == "" and red[4] == " \n"
    assert find_personal(df.limit(0), "doc_id", "text").count() == 0 and redact(df.where(F.lit(False)), "doc_id", "text").count() == 0


def test_masked():
    assert masked("ab cd", [(0, 2, "email"), (3, 5, "phone")]) == "[EMAIL] [PHONE]"
