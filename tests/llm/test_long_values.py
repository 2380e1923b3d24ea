from semloom.llm.mapping import map_values


def test_long_values_and_words(spark):
    words = [a + b + "ixmentor" for a in ("bra", "clu", "dro", "fle", "gri") for b in ("kal", "mos", "pud", "ter", "vin")] + ["zwolfter"]
    entry, word = " ".join(words), "abcdefgh" * 20
    values = spark.createDataFrame([(entry.replace("zwolfter", "zwolfer"),), (word[:-3] + "x" + word[-2:],)], "text string")
    entries = spark.createDataFrame([("long", entry, 0), ("word", word, 1), ("other", "salt", 2)], "concept string, spelling string, ord long")
    assert {r["concept"] for r in map_values(values, entries).collect()} == {"long", "word"}
