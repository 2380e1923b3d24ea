"""Quantities in different units: the unit of each value is read from the row, or inferred, and the value converted.

A unit that a row states is found by a normal form of unit spellings (words,
symbols, exponents, iris) in the value text, the unit fields and then the free
text. A row that states a unit which isn't in the list keeps it: its value is
never given another one. Only where a row states nothing, the values of its kind
of quantity are taken as a mixture on the logarithm of the common value: all
units share one density, and their components stand apart by the known
conversions. EM over a histogram of bounded size fits the density and the
weights of the units; a row gets the unit of highest posterior, flagged where
that is not clear. Everything but the EM step (one small group per quantity) is
built-in expressions. ``hidden_units`` measures the inference on rows that do
state their unit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.session import col, computed

#: Spellings of the words of units; a word that is missing here stands for itself.
WORDS = {
    "per": "/", "degrees": "°", "degree": "°", "deg": "°", "grad": "°", "celsius": "c", "fahrenheit": "f", "kelvin": "k", "kelvins": "k",
    "degc": "°c", "degf": "°f", "degk": "°k", "centigrade": "c",
    "milligram": "mg", "milligrams": "mg", "milligramme": "mg", "milligrammes": "mg", "mgs": "mg",
    "microgram": "ug", "micrograms": "ug", "mcg": "ug", "nanogram": "ng", "nanograms": "ng",
    "gram": "g", "grams": "g", "gramme": "g", "grammes": "g", "gramm": "g", "gm": "g", "gms": "g", "gr": "g",
    "kilogram": "kg", "kilograms": "kg", "kilogramme": "kg", "kilogramm": "kg", "kgs": "kg", "kilo": "kg",
    "pound": "lb", "pounds": "lb", "lbs": "lb", "ounce": "oz", "ounces": "oz",
    "sec": "s", "secs": "s", "second": "s", "seconds": "s", "sekunde": "s", "sekunden": "s", "secondes": "s",
    "mins": "min", "minute": "min", "minutes": "min", "minuten": "min",
    "hr": "h", "hrs": "h", "hour": "h", "hours": "h", "heure": "h", "heures": "h", "std": "h", "stunde": "h", "stunden": "h",
    "day": "d", "days": "d", "tag": "d", "tage": "d", "jour": "d", "jours": "d", "week": "wk", "weeks": "wk", "wks": "wk", "woche": "wk", "wochen": "wk",
    "pascal": "pa", "pascals": "pa", "hectopascal": "hpa", "mbar": "hpa", "millibar": "hpa", "kilopascal": "kpa", "bars": "bar",
    "milliliter": "ml", "milliliters": "ml", "millilitre": "ml", "millilitres": "ml", "cc": "ml",
    "microliter": "ul", "microliters": "ul", "microlitre": "ul", "microlitres": "ul",
    "liter": "l", "liters": "l", "litre": "l", "litres": "l", "millimetre": "mm", "millimeter": "mm", "centimetre": "cm", "centimeter": "cm",
    "kbe": "cfu", "ufc": "cfu", "hundred": "100", "thousand": "1000", "percent": "%", "lg": "log", "metre": "m", "meter": "m", "square": "",
}
#: Normal forms of spellings that are not made of the words above, by unit code.
FORMS = {
    "DEG_C": ["c", "°c"], "DEG_F": ["f", "°f"], "KELVIN": ["k", "°k"],
    "G_100G": ["%w/w", "mass%", "w/w%", "%(m/m)", "%m/m", "%bymass"], "G_KG": ["‰w/w", "‰(m/m)"], "MG_KG": ["ppm"], "MICRO_KG": ["ppb"],
    "KCFU_G": ["103cfu/g", "x103cfu/g", "e3cfu/g", "kcfu/g", "1000cfu/g", "1e3cfu/g", "×103cfu/g"],
    "LOG_CFU_G": ["log10cfu/g", "logcfu/g"], "LN_CFU_G": ["lncfu/g", "naturallogcfu/g"],
    "PA": ["n/m2"], "PSI": ["lbf/in2", "lb/in2", "psia"], "MILLI_L": ["cm3"], "LITRE": ["dm3"], "MICRO_L": ["mm3"],
    "KG_M2_S": ["kgm-2/s", "kg/m2s", "kg/m2/s"], "PER_HR": ["/h"], "PER_DAY": ["/d"], "PER_MIN": ["/min"],
}
NUMBER = r"[+\-−]?(?:\d{1,3}(?:,\d{3})+\.\d+|\d+(?:[.,]\d+)?|\.\d+)(?:[eE][+\-−]?\d+)?"


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s  -​ 　﻿]+", " "))


def unit_key(text: Column) -> Column:
    """The normal form of a unit's spelling; equal units have equal forms. Null for null, '' for blank or bare brackets.

    Each step uses the one before it once, so nested calls stay small in plans.
    """
    plain = F.regexp_replace(_clean(text), "(?i)^https?://|[/#]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "℃", "°c"), "℉", "°f")
    plain = F.translate(F.lower(plain), "µμº˚⁻−¹²³₁₀·⋅*^", "uu°°--12310   ")
    plain = F.regexp_replace(plain, r"colony[- ]forming[- ]units?", "cfu")
    words = F.regexp_extract_all(plain, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    known = F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in WORDS.items()) + ")")
    said = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w)), "")
    said = F.regexp_replace(said, r"(^|[\s.(\[])([a-z]+)-1(?![0-9])", "$1/$2")
    said = F.regexp_replace(said, r"[\s()\[\]]+|\.(?=$|[\s/°\])cfk])", "")
    return F.regexp_replace(F.regexp_replace(said, r"\.?/+", "/"), r"^1/", "/")


def unit_aliases(unit_reference: DataFrame) -> DataFrame:
    """(key, unit_code, quantity, common_unit, transform_name, factor, shift): every normal form of every reference unit."""
    facts = ["quantity", "common_unit", "transform_name", "factor", "shift"]
    forms = F.expr("map(" + ", ".join(f"'{a}', array({', '.join(map(repr, b))})" for a, b in FORMS.items()) + ")")
    spelt = F.concat(
        F.transform(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "unit_name", "iri", "unit_code"))), unit_key), F.coalesce(F.element_at(forms, F.col("unit_code")), F.array().cast("array<string>"))
    )
    keys = unit_reference.select("unit_code", *facts, F.explode(F.array_distinct(spelt)).alias("key")).where("key <> ''")
    # One unit per spelling, the first by code, so that a repeated reference row changes nothing.
    return keys.groupBy("key").agg(F.min(F.struct("unit_code", *facts)).alias("u")).select("key", "u.*")


def one_number(text: Column) -> tuple[Column, Column]:
    """(number, rest): the only number that the text starts with, as double, and the text after it; null where it is no finite number."""
    t = _clean(text)
    digits = F.regexp_extract(t, rf"^({NUMBER})", 1)
    rest = F.trim(F.substring(t, F.length(digits) + 1, F.length(t)))
    thousands = digits.rlike(r",\d{3}\.|,\d{3},")
    point = F.when(thousands, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    number = F.replace(point, F.lit("−"), F.lit("-")).try_cast("double")
    listed = rest.rlike(rf"^(?:[-–—;,:~±]|to\b|bis\b|\.\.)\s*{NUMBER}") | rest.rlike(r"^[-–—;,:±.]")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1.7e308) & ~listed & (digits != "")
    return F.when(finite, number), rest


#: Where a free text names the unit of its number; the unit is group 1. A unit after another number ("batch weight 11 kg") is none of these.
MENTIONS = (
    r"(?i)\bunits?\s*(?::|=|is|are)\s*([^;]+?)\s*$",
    r"(?i)\b(?:reported|expressed|given|measured|stated|recorded)\s+(?:as|in)\s+([^;]+?)\s*$",
    r"\[([^\[\]]+)\]\s*$",
    r"(?<!\w)\(((?:[^()]|\([^()]*\))+)\)\s*$",
    r"(?i)^.*\bin\s+([^;]+?)\s*$",
)


#: How many of the mentions say for certain that what they name is a unit; what the others hold may be any remark.
PLAIN_MENTIONS = 3
#: What stands in a unit field where there is no unit. Fixed values, lower case.
PLACEHOLDERS = ("", "-", "--", "–", "—", "?", "n/a", "na", "n.a.", "none", "null", "nan", "nil", "tbd", "unknown", "missing", "not specified", "unspecified", "not available", "see description", "see text", "see name", "unit", "units")
#: A row states nothing, or something that the reference list doesn't have.
NOTHING, UNKNOWN, INFERRED = None, "unknown", "inferred"


def stated_units(df: DataFrame, unit_reference: DataFrame, key: str, value: str, fields: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(key, number, unit_code, quantity, common_unit, transform_name, factor, shift, unit_from) of each row.

    ``unit_from`` is 'value', the name of the unit field or text that states the
    unit, 'unknown' where a unit is stated that the list doesn't have, or null
    where none is; in both of these the unit's columns are null. The text after
    the number decides where there is any; the unit fields come next in their
    order, then the mentions in ``texts``, each looked at only where none before
    it decides. ``number`` is null where the value holds no single finite number.
    Nulls, blanks and placeholders state nothing; other columns are ignored;
    repeated rows are answered alike.
    """
    facts = F.struct("unit_code", "quantity", "common_unit", "transform_name", "factor", "shift")
    # The reference list is small by nature (a few units, some spellings each): one map, read by a scalar subquery.
    lookup = unit_aliases(unit_reference).agg(F.map_from_entries(F.collect_list(F.struct("key", facts))).alias("m")).scalar()
    number, rest = one_number(F.col("__value"))
    f, t = [f"__f{i}" for i in range(len(fields))], [f"__t{i}" for i in range(len(texts))]
    read = df.select(col(key).alias("__key"), col(value).cast("string").alias("__value"), *(F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, f)), *(col(c).cast("string").alias(n) for c, n in zip(texts, t)))
    numbered = computed(read, "__key", number.alias("__number"), F.coalesce(rest, F.lit("")).alias("__rest"), *f, *t).withColumn("__map", lookup)

    def first(said: Column, names: Sequence[str]) -> Column:
        """(u, by) of the first text of an array that spells a unit; blank texts cost nothing."""
        placed = F.filter(F.zip_with(said, F.array(*map(F.lit, names)), lambda x, by: F.struct(x.alias("x"), by.alias("by"))), lambda p: p["x"] != "")
        known = F.transform(placed, lambda p: F.struct(F.element_at(F.col("__map"), unit_key(p["x"])).alias("u"), p["by"].alias("by")))
        return F.get(F.filter(known, lambda p: p["u"].isNotNull()), F.lit(0))

    # The mentions are read only where neither the value nor a field decides, as coalesce and conditionals are lazy. All of it
    # is one step, as each step that needs the list's map copies it into every row.
    near = F.when(F.col("__rest") != "", F.array(F.col("__rest"), *(F.lit("") for _ in f))).otherwise(F.array(F.lit(""), *map(F.col, f)))
    places = [first(near, ["value", *fields])]
    if texts:
        mentions = F.array(*(F.regexp_extract(F.coalesce(_clean(F.col(n)), F.lit("")), m, 1) for n in t for m in MENTIONS))
        places.append(F.when(F.col("__rest") == "", first(mentions, [c for c in texts for _ in MENTIONS])))
    found = computed(numbered, "__key", "__number", "__rest", *f, *t, F.coalesce(*places).alias("__s"))
    blank = lambda c: F.lower(_clean(c)).isin(*PLACEHOLDERS)
    mentioned = [F.regexp_extract(F.coalesce(_clean(F.col(n)), F.lit("")), m, 1) == "" for n in t for m in MENTIONS[:PLAIN_MENTIONS]]
    silent = F.col("__rest") == ""
    for c in [*(blank(F.col(n)) for n in f), *mentioned]:
        silent = silent & c
    source = F.coalesce(F.col("__s.by"), F.when(~silent, UNKNOWN))
    return found.select(F.col("__key").alias(key), F.col("__number").alias("number"), F.col("__s.u.*"), source.alias("unit_from"))


def common_value(number: Column, transform: Column, factor: Column, shift: Column) -> Column:
    """factor * f(number) + shift; null where a logarithm is asked of a number that has none."""
    scaled = F.when(transform == "log10", F.when(number > 0, F.log10(number))).otherwise(number)
    return factor * scaled + shift


#: Width of a histogram bin as a share of a decade; its inverse bounds the bins of one quantity (about 630 decades of doubles).
BINS_PER_DECADE = 50


def _bins(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.signum(x) * (F.round(F.log10(F.abs(x)) * BINS_PER_DECADE) + 400 * BINS_PER_DECADE)).cast("int")


#: Normal components of the density of one quantity.
COMPONENTS = 5


def _scale(units: Sequence[tuple[str, str, float, float]]) -> float | None:
    """What is added to a common value before its logarithm is taken; null where the common value is a logarithm already.

    Units with different zeros (temperatures) are put on the scale from the lowest of these zeros.
    """
    if any(u[1] == "log10" for u in units):
        return None
    return max(0.0, -min(u[3] for u in units))


def _fit(units: dict[str, list[tuple[str, str, float, float]]], rounds: int):
    """The EM step of one quantity, over its histogram."""

    def placed(x: np.ndarray, unit: tuple[str, str, float, float], zero: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Place of numbers in a unit on the logarithmic scale, and what a step of the number is there; nan where there is none."""
        _, transform, factor, shift = unit
        with np.errstate(all="ignore"):
            y = factor * (np.log10(x) if transform == "log10" else x) + shift
            slope = abs(factor) / (x * math.log(10)) if transform == "log10" else np.full(len(x), abs(factor))
            if zero is None:
                return np.where(np.isfinite(y), y, np.nan), slope
            return np.where(y + zero > 0, np.log10(y + zero), np.nan), slope / ((y + zero) * math.log(10))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["quantity", "unit_code", "weight", "zero", "mu", "sigma", "share"]
        quantity = rows["quantity"].iloc[0]
        own = units[quantity]
        zero = _scale(own)
        said, open_ = rows[rows["unit_code"] != ""], rows[rows["unit_code"] == ""]
        z0 = said["x"].to_numpy(float)
        with np.errstate(all="ignore"):
            z0 = z0 if zero is None else np.where(z0 + zero > 0, np.log10(z0 + zero), np.nan)
        n0, ok = said["n"].to_numpy(float), np.isfinite(z0)
        z0, n0 = z0[ok], n0[ok]
        if n0.sum() < 20:
            return pd.DataFrame([], columns=columns)
        x, n = open_["x"].to_numpy(float), open_["n"].to_numpy(float)
        at = [placed(x, u, zero) for u in own]
        z, slope = np.stack([a for a, _ in at], 1), np.stack([b for _, b in at], 1)
        order = np.argsort(z0)
        share = np.cumsum(n0[order]) / n0.sum()
        mu = np.interp((np.arange(COMPONENTS) + 0.5) / COMPONENTS, share, z0[order])
        least = max(1e-3, 0.02 * (z0.max() - z0.min()))
        sigma, part = np.full(COMPONENTS, max(least, z0.std() / COMPONENTS)), np.full(COMPONENTS, 1 / COMPONENTS)
        # The units of the stated rows are where the weights begin; one row of each is added.
        seen = said.groupby("unit_code")["n"].sum()
        prior = np.array([float(seen.get(u[0], 0)) + 1 for u in own])
        weight = prior / prior.sum()
        normal = lambda v: part * np.exp(-((v[..., None] - mu) ** 2) / (2 * sigma**2)) / sigma
        for _ in range(rounds):
            a = normal(z0)
            a = a / np.maximum(a.sum(1, keepdims=True), 1e-300) * n0[:, None]
            total, first, second = a.sum(0), (a * z0[:, None]).sum(0), (a * z0[:, None] ** 2).sum(0)
            if len(x):
                b = np.nan_to_num(normal(np.nan_to_num(z)) * (weight * np.where(np.isfinite(z), slope, 0))[..., None])
                b = b / np.maximum(b.sum((1, 2), keepdims=True), 1e-300) * n[:, None, None]
                zz = np.nan_to_num(z)[..., None]
                total, first, second = total + b.sum((0, 1)), first + (b * zz).sum((0, 1)), second + (b * zz**2).sum((0, 1))
                mass = b.sum((0, 2))
                # The share of units among rows without one may be another than among stated rows.
                weight = (mass + 5 * prior / prior.sum()) / (mass.sum() + 5)
            safe = np.maximum(total, 1e-9)
            mu, sigma, part = first / safe, np.sqrt(np.maximum(second / safe - (first / safe) ** 2, least**2)), total / total.sum()
        return pd.DataFrame([(quantity, u[0], w, zero, mu.tolist(), sigma.tolist(), part.tolist()) for u, w in zip(own, weight.tolist())], columns=columns)

    return fit


def _read(df: DataFrame, unit_reference: DataFrame, key: str, value: str, fields: Sequence[str], texts: Sequence[str], category: str | None) -> DataFrame:
    """Rows of ``stated_units`` that hold a number, with ``__key``, ``__lead`` (the words that open the first text) and ``__hint`` (the category)."""
    lead = F.lower(F.regexp_extract(F.coalesce(col(texts[0]), F.lit("")), r"^\s*(\S+(?:\s+\S+)?)", 1)) if texts else F.lit("")
    hint = F.lower(_clean(col(category))) if category else F.lit(None).cast("string")
    plain = [value, *fields, *texts]
    names = [f"__c{i}" for i in range(len(plain))]
    packed = df.select(F.struct(col(key).alias("__key"), lead.alias("__lead"), hint.alias("__hint")).alias("__key"), *(col(c).alias(n) for c, n in zip(plain, names)))
    read = stated_units(packed, unit_reference, "__key", names[0], names[1 : 1 + len(fields)], names[1 + len(fields) :]).where("number is not null")
    labels = F.create_map(*(F.lit(x) for pair in zip(names, plain) for x in pair))
    return read.withColumn("unit_from", F.coalesce(F.element_at(labels, F.col("unit_from")), F.col("unit_from"))).select("__key.*", *(c for c in read.columns if c != "__key"))


def _quantities(open_: DataFrame, said: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """(__key, number, quantity) of rows without a unit: by the category, else by the opening words where nine tenths of the stated rows with these words agree."""
    by_lead = said.groupBy("__lead", F.col("quantity").alias("__q")).agg(F.count(F.lit(1)).alias("n"))
    by_lead = by_lead.groupBy("__lead").agg(F.max_by("__q", F.struct("n", "__q")).alias("__q"), F.max("n").alias("m"), F.sum("n").alias("s")).where("__lead <> '' and m >= 0.9 * s").select("__lead", "__q")
    known = unit_reference.select(F.lower("quantity").alias("__hint"), F.col("quantity").alias("__h")).distinct()
    return open_.join(known, "__hint", "left").join(by_lead, "__lead", "left").select("__key", "number", F.coalesce("__h", "__q").alias("quantity"))


def infer_units(placed: DataFrame, said: DataFrame, unit_reference: DataFrame, clear: float, rounds: int) -> DataFrame:
    """(__key, number, unit_code, quantity, common_unit, common, posterior, uncertain) of rows (__key, number, quantity) by the mixtures fitted on them and on stated rows."""
    common = common_value(F.col("number"), F.col("transform_name"), F.col("factor"), F.col("shift"))
    hist = said.select("quantity", "unit_code", common.alias("x")).where("x is not null").unionByName(placed.where("quantity is not null").select("quantity", F.lit("").alias("unit_code"), F.col("number").alias("x")))
    hist = hist.groupBy("quantity", "unit_code", _bins(F.col("x")).alias("bin")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    units: dict[str, list[tuple[str, str, float, float]]] = {}
    # The reference list is a list of units, a few hundred rows at most; more would be another table.
    for r in unit_reference.select("quantity", "unit_code", "transform_name", "factor", "shift").distinct().orderBy("unit_code").limit(10_001).collect():
        units.setdefault(r[0], []).append((r[1], r[2], float(r[3]), float(r[4])))
    if sum(map(len, units.values())) > 10_000:
        raise ValueError("the list of units has more than 10,000 rows")
    fitted = hist.groupBy("quantity").applyInPandas(_fit(units, rounds), "quantity string, unit_code string, weight double, zero double, mu array<double>, sigma array<double>, share array<double>")
    facts = unit_reference.select("unit_code", "common_unit", "transform_name", "factor", "shift").distinct()
    model = fitted.join(facts, "unit_code").groupBy("quantity").agg(F.collect_list(F.struct("unit_code", "common_unit", "transform_name", "factor", "shift", "weight", "zero", "mu", "sigma", "share")).alias("__units"))

    def score(u: Column) -> Column:
        x = F.col("number")
        logs = u["transform_name"] == "log10"
        y = common_value(x, u["transform_name"], u["factor"], u["shift"])
        slope = F.when(logs, u["factor"] / (x * math.log(10))).otherwise(u["factor"])
        above = y + u["zero"]
        z = F.when(u["zero"].isNull(), y).when(above > 0, F.log10(above))
        dz = F.abs(F.when(u["zero"].isNull(), slope).otherwise(slope / (above * math.log(10))))
        parts = F.zip_with(F.arrays_zip(u["mu"], u["sigma"]), u["share"], lambda m, w: w / m["sigma"] * F.exp(-F.pow((z - m["mu"]) / m["sigma"], F.lit(2)) / 2))
        dense = u["weight"] * dz * F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.coalesce(dense, F.lit(0.0)).alias("score"), u["unit_code"].alias("unit_code"), u["common_unit"].alias("common_unit"), y.alias("common"))

    scored = placed.join(model, "quantity", "left").select("__key", "number", "quantity", F.transform("__units", score).alias("__s"))
    total = F.aggregate("__s", F.lit(0.0), lambda s, v: s + v["score"])
    best = scored.select("__key", "number", "quantity", F.array_max("__s").alias("__b"), total.alias("__n"))
    ok = F.coalesce(F.col("__n") > 0, F.lit(False))
    posterior = F.when(ok, F.col("__b.score") / F.col("__n"))
    return best.select(
        "__key", "number", F.when(ok, F.col("__b.unit_code")).alias("unit_code"), "quantity", F.when(ok, F.col("__b.common_unit")).alias("common_unit"), F.when(ok, F.col("__b.common")).alias("common"),
        posterior.alias("posterior"), F.coalesce(posterior < clear, F.lit(True)).alias("uncertain"),
    )


def resolve_units(
    df: DataFrame, unit_reference: DataFrame, key: str, value: str, fields: Sequence[str], texts: Sequence[str], category: str | None = None,
    clear: float = 0.9, rounds: int = 40,
) -> DataFrame:
    """(key, number, unit_code, quantity, common_unit, common, unit_from, posterior, uncertain) of each row that holds one finite number.

    Rows that state their unit keep it (posterior 1). Rows that state a unit
    which isn't in the list have null units and ``unit_from`` 'unknown'. A row
    that states none is assigned a quantity, by ``category`` or by the words that
    open its first text where nine tenths of the stated rows with these words
    agree, and then the unit of highest posterior (``unit_from`` 'inferred');
    ``uncertain`` marks a posterior under ``clear``. Rows of unknown quantity, or
    of a quantity with fewer than 20 stated values, have null units. Nulls and an
    empty table are no special case; other columns are ignored.
    """
    read = _read(df, unit_reference, key, value, fields, texts, category)
    out = ["__key", "number", "unit_code", "quantity", "common_unit", "common", "unit_from", "posterior", "uncertain"]
    common = common_value(F.col("number"), F.col("transform_name"), F.col("factor"), F.col("shift"))
    said = read.where("unit_code is not null")
    stated = said.select("__key", "number", "unit_code", "quantity", "common_unit", common.alias("common"), "unit_from", F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain"))
    none = lambda t: F.lit(None).cast(t)
    unknown = read.where(F.col("unit_from") == UNKNOWN).select("__key", "number", none("string").alias("unit_code"), none("string").alias("quantity"), none("string").alias("common_unit"), none("double").alias("common"), "unit_from", none("double").alias("posterior"), F.lit(True).alias("uncertain"))
    placed = _quantities(read.where("unit_from is null"), said, unit_reference)
    inferred = infer_units(placed, said, unit_reference, clear, rounds).withColumn("unit_from", F.lit(INFERRED))
    return stated.unionByName(unknown).select(*out).unionByName(inferred.select(*out)).select(F.col("__key").alias(key), *out[1:])


def hidden_units(
    df: DataFrame, unit_reference: DataFrame, key: str, value: str, fields: Sequence[str], texts: Sequence[str], category: str | None = None,
    clear: float = 0.9, rounds: int = 40,
) -> DataFrame:
    """(key, quantity, unit_code, inferred_quantity, inferred_unit, posterior, uncertain): every row that states its unit, with the unit inferred as if it didn't.

    Rows are halved by the hash of their key; each half is inferred by mixtures
    fitted on the stated units of the other and on its own bare numbers.
    """
    read = _read(df, unit_reference, key, value, fields, texts, category).where("unit_code is not null").withColumn("__half", F.pmod(F.xxhash64("__key"), F.lit(2)))
    out = None
    for half in (0, 1):
        said = read.where(F.col("__half") != half)
        placed = _quantities(read.where(F.col("__half") == half), said, unit_reference)
        part = infer_units(placed, said, unit_reference, clear, rounds)
        out = part if out is None else out.unionByName(part)
    found = out.select("__key", F.col("quantity").alias("inferred_quantity"), F.col("unit_code").alias("inferred_unit"), "posterior", "uncertain")
    return read.select("__key", "quantity", "unit_code").join(found, "__key").select(F.col("__key").alias(key), "quantity", "unit_code", "inferred_quantity", "inferred_unit", "posterior", "uncertain")
