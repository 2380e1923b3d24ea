"""Free-entered values mapped to a canonical list: token repair by edit distance, then soft TF-IDF over whole entries.

Distinct values are cleaned and cut into tokens once. Values whose words, or
whose letters without blanks, are those of an entry are done. The distinct
tokens of the rest are joined to the vocabulary of the list over shared deletion
neighbours (words that are equal after taking out at most one or two letters),
which gives every pair within the edit distance without comparing all pairs; the
vocabulary holds neighbouring words run together too. What a value may stand for
is then gathered once, as an array. Its heaviest words lead to entries: as many
as are needed so that an entry that holds none of them can't reach the score.
Soft TF-IDF over all words of value and entry decides, missing and extra words
included, by array functions. Values of which nothing is found are tried again
with neighbouring tokens run together. All sides grow with distinct values and
tokens, none with the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.session import computed, shared_folder

#: Lists of up to this many entries are broadcast with their neighbours (some 80 short words a token); longer ones are shuffled.
BROADCAST_ENTRIES = 20_000
#: Tokens from this length on may be two edits away, from ``SHORT`` on one; shorter ones have to agree.
LONG, SHORT = 7, 4
#: What a single letter that begins a word counts of it.
INITIAL = 0.9
#: Words that say little on what is meant, and the weight they have at most (a rare word of a list of a thousand entries weighs 7). Fixed values.
LIGHT_WORDS = ("of", "the", "in", "on", "for", "and", "or", "per", "to", "a", "an", "value", "values", "level", "data", "parameter", "variable", "type", "sp", "spp", "cf", "strain", "subsp", "serovar", "serotype")
LIGHT = 0.7
#: What people add to a value that isn't part of it: list numbers, marks of doubt, lot and sample numbers. Fixed values, may be given otherwise.
DECORATION = (
    r"^\s*\(?\d+\s*[).:]\s+",
    r"^\s*(?:cf|aff|ca|approx|e\.g)\.?\s+",
    r"\s*[-–,(\[]?\s*\b(?:lot|batch|sample|no|nr)\.?\s*#?\d+\s*[)\]]?\s*$",
    r"\s*[,(\[]\s*(?:unspecified|not specified|n\.?o\.?s\.?|unknown)\s*[)\]]?\s*$",
    r"_(?:in|out|input|output)$",
    r"^[\s\"'`*?;:,.\[{<]+|[\s\"'`*?;:,.\]}>!]+$",
)
_DECOR = [re.compile(x, re.I) for x in DECORATION]
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_SPLIT = re.compile(r"[\W_]+")


def value_tokens(text: str) -> list[str]:
    """The words of a value: compatibility forms, accents and invisible marks folded, decoration taken off, code names cut at capitals."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    while True:
        plain = folded
        for d in _DECOR:
            plain = d.sub("", plain)
        if plain == folded:
            break
        folded = plain
    if not re.search(r"\s", folded):
        parts = _CAMEL.sub(" ", folded)
        folded = re.sub(r"\d+$", "", parts) if parts != folded else folded
    return [t for t in _SPLIT.split(folded.lower()) if t]


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words = [value_tokens(t) for t in b["text"]]
        yield pd.DataFrame({"text": b["text"], "tokens": words, "bag": [" ".join(sorted(w)) for w in words], "compact": ["".join(w) for w in words]})


def tokenised(texts: DataFrame) -> DataFrame:
    """(text, tokens, bag (the tokens in order of the alphabet), compact (run together)) of distinct non-blank texts."""
    return texts.select("text").where("trim(text) <> ''").distinct().mapInPandas(_clean, "text string, tokens array<string>, bag string, compact string")


def _without_one(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))


def neighbours(w: Column, most: int = 2) -> Column:
    """The word and what is left of it after taking out one letter, or up to two for long words."""
    one = F.when(F.length(w) >= SHORT, _without_one(w)).otherwise(F.array().cast("array<string>"))
    if most < 2:
        return F.array_distinct(F.concat(F.array(w), one))
    two = F.when(F.length(w) >= LONG, F.flatten(F.transform(_without_one(w), _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), one, two))


def repairs(tokens: DataFrame, vocabulary: DataFrame, small: bool, most: int = 2) -> DataFrame:
    """(token, word, sim): every word of the vocabulary within the edit distance of a token, ``most`` edits at most; a swap of two letters is one edit. An edit takes half of its share of the word from the similarity."""
    longest = vocabulary.agg(F.max(F.length("word"))).scalar() + most
    side = vocabulary.select("word", F.explode(neighbours(F.col("word"), most)).alias("n"))
    side = F.broadcast(side) if small else side
    # A longer token than the longest word and its edits is within the distance of none.
    pairs = tokens.where(F.length("token") <= longest).select("token", F.explode(neighbours(F.col("token"), most)).alias("n")).join(side, "n").select("token", "word").distinct()
    d = F.levenshtein("token", "word")
    swapped = (F.length("token") == F.length("word")) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("word", "")))
    edits = F.when(swapped & (d == 2), 1).otherwise(d)
    size = F.greatest(F.length("token"), F.length("word"))
    bound = F.when(F.least(F.length("token"), F.length("word")) >= LONG, most).when(size >= SHORT, 1).otherwise(0)
    return pairs.where(edits <= bound).select("token", "word", (1 - edits / (2 * size)).alias("sim"))


def entry_index(entries: DataFrame) -> DataFrame:
    """(entry, compact, tokens, concept, ord, words, norm, n): every distinct entry of (concept, spelling, ord); words are (idf, word), the heaviest first."""
    # One row per spelling; where two entries share one, the first by order has it.
    spelt = entries.where("trim(spelling) <> ''").groupBy(F.col("spelling").alias("text")).agg(F.min(F.struct("ord", "concept")).alias("f"))
    listed = tokenised(spelt).join(spelt, "text").select("tokens", "bag", "compact", F.col("f.concept").alias("concept"), F.col("f.ord").alias("ord"))
    listed = listed.groupBy("bag").agg(F.min(F.struct("ord", "concept", "tokens", "compact")).alias("f")).select("bag", "f.*").where("bag <> ''")
    words = listed.select("bag", F.explode(F.array_distinct("tokens")).alias("word"))
    n = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    idf = F.log(1 + F.col("n") / F.col("df"))
    weighed = words.join(df.select("word", "n", F.when(F.col("word").isin(*LIGHT_WORDS), F.least(idf, F.lit(LIGHT))).otherwise(idf).alias("idf")), "word")
    # An entry has a few words, so this group is bounded by its text.
    arrays = weighed.groupBy("bag").agg(F.sort_array(F.collect_list(F.struct("idf", "word")), asc=False).alias("words"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"), F.first("n").alias("n"))
    return listed.join(arrays, "bag").select(F.col("bag").alias("entry"), "compact", "tokens", "concept", "ord", "words", "norm", "n")


def _slots(spots: DataFrame, hits: DataFrame, most: Column) -> DataFrame:
    """(bag, letters, hits, known, lost, total) of values: all (keys, word, sim) their tokens may stand for, and the words that lead to entries.

    ``spots``: (bag, pos, token, keys, single), ``hits``: (token, word, half, sim, idf). A token has two keys, which a word it
    stands for takes up both of, or one where two words were run together. ``most`` is the weight of a word that isn't in the list.
    """
    met = spots.join(hits, "token", "left")
    own = F.when(F.col("half").isNull(), F.col("keys")).otherwise(F.array(F.element_at("keys", F.col("half"))))
    hit = F.when(F.col("word").isNotNull(), F.struct(own.alias("keys"), "word", "sim"))
    # A value has a few words and a word a few repairs, so this group is bounded by its text.
    slot = met.groupBy("bag", "pos", "single", "token").agg(F.max("idf").alias("idf"), F.collect_list(hit).alias("hits"))
    letter = F.length("token") == 1
    weight = F.when(letter, 0.0).otherwise(F.coalesce("idf", F.when(F.col("token").isin(*LIGHT_WORDS), LIGHT).otherwise(most)))
    bags = slot.groupBy("bag").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.collect_list(F.when(F.col("single") & letter, F.col("token"))).alias("letters"),
        F.collect_list(F.when(F.col("single"), F.struct((weight * weight).alias("w"), F.col("pos"), F.col("idf").isNotNull().alias("known")))).alias("slots"),
    )
    return bags


def _ranked(bags: DataFrame, index: DataFrame, small: bool, accept: float) -> DataFrame:
    """(bag, concept, score): the entry of highest soft TF-IDF of each value, where it reaches ``accept``."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    sums = computed(
        bags, "bag", "hits", "letters", F.reverse(F.array_sort(F.filter("slots", lambda x: x["known"]))).alias("known"), total("slots", lambda x: F.when(x["known"], x["w"]).otherwise(0.0)).alias("k"),
        total("slots", lambda x: F.when(x["known"], 0.0).otherwise(x["w"])).alias("u"), F.col("most"),
    ).withColumn("open", F.size("letters") * F.col("most") * F.col("most"))
    # An entry that holds none of the leading words scores at most the root of what the others weigh; likewise all words together.
    able = sums.where(F.col("k") + F.col("open") >= accept * accept * (F.col("k") + F.col("open") + F.col("u")))
    least = accept * accept * (F.col("k") + F.col("open") + F.col("u"))
    lead = F.aggregate("known", F.struct(F.array().cast("array<int>").alias("pos"), (F.col("k") + F.col("open")).alias("left")), lambda a, x: F.when(a["left"] < least, a).otherwise(F.struct(F.concat(a["pos"], F.array(x["pos"])).alias("pos"), (a["left"] - x["w"]).alias("left"))))
    led = computed(able, "bag", "hits", "letters", "known", "u", lead["pos"].alias("lead"))
    words = F.array_distinct(F.transform(F.filter("hits", lambda h: F.arrays_overlap(h["keys"], F.flatten(F.transform("lead", lambda p: F.array(2 * p, 2 * p + 1))))), lambda h: h["word"]))
    postings = index.select("entry", "concept", "ord", "words", "norm", F.explode("words.word").alias("word"))
    postings = F.broadcast(postings) if small else postings
    met = led.withColumn("word", F.explode(words)).join(postings, "word").drop("word")
    # First a bound without regard to which token serves which word.
    sim = lambda w: F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(F.filter("hits", lambda h: h["word"] == w), lambda h: h["sim"]), F.when(F.array_contains("letters", F.substring(w, 1, 1)), F.array(F.lit(INITIAL))).otherwise(F.array().cast("array<double>"))))
    bound = computed(met, *met.columns, F.aggregate("words", F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["dot"] + sim(x["word"]) * x["idf"] * x["idf"]).alias("dot"), (a["s"] + F.when(sim(x["word"]) > 0, x["idf"] * x["idf"]).otherwise(0.0)).alias("s"))).alias("b"))
    near = bound.where(F.col("b.dot") >= accept * F.col("norm") * F.sqrt(F.col("b.dot") + F.col("u")) - 1e-9).drop("b").dropDuplicates(["bag", "entry"])

    # Then word by word, the heaviest first: each takes the best token that is still free, else a letter that begins it.
    kind = "struct<used:array<int>,letters:array<string>,dot:double,s:double>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.col("letters").alias("letters"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("s")).cast(kind)

    def take(a: Column, x: Column) -> Column:
        free = F.filter("hits", lambda h: (h["word"] == x["word"]) & ~F.arrays_overlap(h["keys"], a["used"]))
        best = F.array_max(F.transform(free, lambda h: F.struct(h["sim"].alias("sim"), h["keys"].alias("keys"))))
        first = F.substring(x["word"], 1, 1)
        w = x["idf"] * x["idf"]
        by_word = F.struct(F.concat(a["used"], best["keys"]).alias("used"), a["letters"].alias("letters"), (a["dot"] + best["sim"] * w).alias("dot"), (a["s"] + w).alias("s"))
        at = F.array_position(a["letters"], first).cast("int")
        without = F.concat(F.slice(a["letters"], F.lit(1), at - 1), F.slice(a["letters"], at + 1, F.size(a["letters"])))
        by_letter = F.struct(a["used"].alias("used"), without.alias("letters"), (a["dot"] + INITIAL * w).alias("dot"), (a["s"] + w).alias("s"))
        return F.when(best.isNotNull(), by_word).when(at > 0, by_letter).otherwise(a).cast(kind)

    taken = computed(near, "bag", "concept", "ord", "norm", "u", "known", F.aggregate("words", start, take).alias("t"))
    # Words of the value that serve none of the entry's count with their own weight.
    unused = total(F.filter("known", lambda x: ~F.array_contains("t.used", 2 * x["pos"]) & ~F.array_contains("t.used", 2 * x["pos"] + 1)), lambda x: x["w"])
    score = F.col("t.dot") / (F.col("norm") * F.sqrt(F.col("t.s") + F.col("u") + unused + LIGHT * LIGHT * F.size("t.letters")))
    scored = computed(taken, "bag", "concept", (-F.col("ord")).alias("o"), F.round(score, 9).alias("score")).where(F.col("score") >= accept)
    return scored.groupBy("bag").agg(F.max(F.struct("score", "o", "concept")).alias("f")).select("bag", "f.concept", "f.score")


def map_values(values: DataFrame, entries: DataFrame, accept: float = 0.85) -> DataFrame:
    """(text, concept, score) of every distinct non-blank ``values.text``; concept is null where no entry of the list is meant.

    ``entries``: (concept, spelling, ord), labels and synonyms alike. Equal bags
    of words, and equal letters without blanks, score 1. Otherwise soft TF-IDF of
    the value's repaired words and the entry's decides: a word within the edit
    distance counts with its similarity, a single letter stands for a word that
    begins with it, two neighbouring words may be run together on either side,
    missing and extra words lower the score by their weight. The highest score
    from ``accept`` on wins, then the smallest ``ord``. Nulls and blanks give no
    row; repeated values are mapped once; an empty list maps every value to null.
    """
    shared_folder(values.sparkSession)
    # What is used more than once is written to the shared folder, so that plans stay small and nothing is computed twice.
    index = entry_index(entries).checkpoint()
    small = index.count() <= BROADCAST_ENTRIES
    hint = F.broadcast if small else (lambda d: d)
    by_bag = index.select(F.col("entry").alias("bag"), F.col("concept").alias("c1"))
    by_letters = index.groupBy("compact").agg(F.min(F.struct("ord", "concept"))["concept"].alias("c2"))
    exact = tokenised(values).join(hint(by_bag), "bag", "left").join(hint(by_letters), "compact", "left").select("text", "tokens", "bag", F.coalesce("c1", "c2").alias("concept")).checkpoint()
    hit = exact.where("concept is not null").select("text", "concept", F.lit(1.0).alias("score"))
    open_ = exact.where("concept is null and size(tokens) > 0").select("tokens", "bag").dropDuplicates(["bag"])

    most = F.log(1 + index.agg(F.max("n")).scalar())
    words = index.select(F.explode("words").alias("w")).select("w.word", "w.idf").distinct()
    pair = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b")))
    runs = index.where(F.size("tokens") > 1).select(F.inline(pair("tokens"))).distinct().select(F.concat("a", "b").alias("run"), F.inline(F.array(F.struct(F.col("a").alias("word"), F.lit(1).alias("half")), F.struct(F.col("b").alias("word"), F.lit(2).alias("half")))))
    meaning = words.select(F.col("word").alias("run"), "word", F.lit(None).cast("int").alias("half")).unionByName(runs).join(words, "word")
    single = open_.select("bag", F.posexplode("tokens").alias("pos", "token")).select("bag", "pos", "token", F.array(2 * F.col("pos"), 2 * F.col("pos") + 1).alias("keys"), F.lit(True).alias("single"))

    def hits(spots: DataFrame, targets: DataFrame, edits: int) -> DataFrame:
        found = repairs(spots.where(F.length("token") > 1).select("token").distinct(), targets.select(F.col("run").alias("word")).distinct(), small, edits)
        return found.join(hint(targets.withColumnRenamed("word", "__w")), found["word"] == F.col("run")).select("token", F.col("__w").alias("word"), "half", "sim", "idf")

    own = hits(single, meaning, 2)
    first_bags = _slots(single, own, most).withColumn("most", most).checkpoint()
    first = _ranked(first_bags, index, small, accept).checkpoint()
    # What is left and has a word that stands for nothing: tokens run together, one edit away at most.
    left = first_bags.where(F.exists("slots", lambda x: ~x["known"] & (x["w"] > LIGHT * LIGHT)) & (F.size("slots") > 1)).join(first, "bag", "left_anti")
    again = open_.join(left.select("bag"), "bag", "left_semi").select("bag", F.posexplode(pair("tokens")).alias("pos", "p"))
    double = again.select("bag", "pos", F.concat("p.a", "p.b").alias("token"), F.array(*(2 * F.col("pos") + i for i in range(4))).alias("keys"))
    run = double.join(hits(double, meaning.where("half is null"), 1), "token").select("bag", "pos", "keys", "word", "sim", "idf")
    # Both tokens count as known where their run is; each with half of its weight.
    more = run.groupBy("bag").agg(F.collect_list(F.struct("keys", "word", "sim")).alias("more"), F.collect_list(F.struct("pos", (F.col("idf") * F.col("idf") / 2).alias("w"))).alias("runs"))
    weighed = lambda x: F.filter(F.col("runs"), lambda r: (r["pos"] == x["pos"]) | (r["pos"] + 1 == x["pos"]))
    joined = left.join(more, "bag").select(
        "bag", F.concat("hits", "more").alias("hits"), "letters", "most",
        F.transform("slots", lambda x: F.when(x["known"] | (F.size(weighed(x)) == 0), x).otherwise(F.struct(F.array_max(F.transform(weighed(x), lambda r: r["w"])).alias("w"), x["pos"].alias("pos"), F.lit(True).alias("known")))).alias("slots"),
    )
    second = _ranked(joined, index, small, accept)
    found = first.unionByName(second)
    fuzzy = exact.where("concept is null").select("text", "bag").join(found, "bag", "left").select("text", "concept", "score")
    return hit.unionByName(fuzzy)
