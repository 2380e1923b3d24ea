from semloom.llm.mapping import map_values, value_tokens

ENTRIES = [(1, "roasted almond powder", 0), (2, "doubling acidity", 1), (3, "doubling acidity of oyster", 2), (4, "Busfeella grialtcathum", 3), (5, "kilogram", 4), (6, "vacuum-packed tomato", 5), (2, "quuwort bremash", 99), (7, "Gisarkia modruii", 7)]
CASES = {
    "Roasted  Almond Powder": 1, "powder, roasted almond": 1, "rosated almnod powdr": 1, "roastedAlmondPowder": 1, "doubling acidity": 2, "cf. doubling acidity - lot 17": 2, "quuwort bremash": 2,
    "doubling acidity of oyster (sample 3)": 3, "B. grialtcathum": 4, "B.grialtcathm": 4, "Busfeellá grialtcathum ?": 4, "12) kilogram*": 5, "[vacuum_packed tomato]": 6, "vacuum​-packed tomato, unspecified": 6,
    "doubling acidity of": 2, "doubling density": None, "lychee": None, "???": None, "12345": None, "x" * 5000: None, "word " * 3000: None, "M. grialtcathum": None, "G. modruii": 7,
}


def test_cases(spark):
    df = spark.createDataFrame([(t, 1, "c") for t in CASES] * 2 + [(None, 1, "c"), ("", 1, "c"), ("  ", 1, "c")], "text string, concept int, bag string")
    entries = spark.createDataFrame(ENTRIES, "concept long, spelling string, ord long")
    out = map_values(df, entries).collect()
    got = {r["text"]: r["concept"] for r in out}
    assert len(out) == len(got)
    for text, want in CASES.items():
        assert got.get(text) == want, text[:60]


def test_words_run_together_missing_and_extra(spark):
    entries = spark.createDataFrame([(1, "water activity", 0), (2, "salmonella enterica", 1), (3, "growth rate", 2), (4, "water content", 3)], "concept long, spelling string, ord long")
    want = {
        "salmonela enterica serovar": 2, "water activty value": 1, "wateractivity": 1, "waterr activity": 1, "wateractivty": 1, "wat er activity": 1, "wat er activty": 1, "activity of water": 1,
        "water": None, "water temperature": None, "growth rate content": None, "rate growth parameter": 3, "s. enterica": 2,
    }
    got = {r["text"]: r["concept"] for r in map_values(spark.createDataFrame([(t,) for t in want], "text string"), entries).collect()}
    assert got == want


def test_empty(spark):
    entries = spark.createDataFrame(ENTRIES, "concept long, spelling string, ord long")
    values = spark.createDataFrame([("kilogram",)], "text string")
    assert map_values(values.limit(0), entries).count() == 0
    assert [r["concept"] for r in map_values(values, entries.limit(0)).collect()] == [None]


def test_tokens():
    assert value_tokens("21) cf. Organic Almond ?") == ["organic", "almond"]
    assert value_tokens("shelfLifeMoisture12") == ["shelf", "life", "moisture"]
    assert value_tokens("  ") == []
