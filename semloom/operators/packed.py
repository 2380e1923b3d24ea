"""Several values packed in one field: one row per value, with its position.

Quoted spans and escaped characters are first replaced by indexed placeholders
that cannot collide with the text (the two marks that enclose an index are
themselves replaced where a text already holds them). What remains is split at
the delimiters of the field, each placeholder is restored by an array lookup,
and the values are exploded with their positions. All of it is built-in
expressions: no shuffle, no Python, one pass over the field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.session import col

#: Private-use characters: around a placeholder's index, and between parts. Where a text holds them they are protected like quoted spans.
OPEN, CLOSE, PART = "\ue000", "\ue001", "\ue002"
BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
_MARKS = ",;|\\t\\r\\n、，；\\[\\]/"
#: A span within double quotes (inner quotes doubled or escaped), not opened within a word.
_DOUBLE = r'"(?<![\p{L}\p{N}"]")(?:[^"\\]++|""|\\.)*+"'
#: A span within single quotes; it has to begin and end where an item does, as apostrophes are common.
_SINGLE = rf"'(?<=(?:^|[{_MARKS}])\s{{0,9}}')(?:[^'\\]++|''|\\.|'(?!\s{{0,9}}+(?:$|[{_MARKS}])))*+'(?=\s*+(?:$|[{_MARKS}]))"
SPAN = rf"(?s)(?:{_DOUBLE}|{_SINGLE}|\\.|[{OPEN}{CLOSE}{PART}])"
PLACE = rf"(?s){OPEN}(\d+){CLOSE}"
#: Delimiters of a field with strong marks, and of one without. A comma between two digits and a slash without blanks never split.
STRONG = r"[;；|\r\n]"
SPLIT_STRONG = rf"[;；|\r\n\t]|(?<={BLANK})/(?={BLANK})"
SPLIT_COMMA = rf"\t|[、，]|(?<=(\D|^)),|,(?=(\D|$))|(?<={BLANK})/(?={BLANK})"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")


def _parts(c: Column, between: str) -> Column:
    """The parts of a text between the matches; ``split`` itself would compile the pattern for every row."""
    return F.split(F.regexp_replace(c, between, PART), PART, -1)


def _unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def _span_value(span: Column) -> Column:
    """The text that a protected span within a longer value stands for: an escaped character itself, a quoted span as it is."""
    return F.when(span.startswith("\\"), F.substring(span, 2, 1)).otherwise(span)


def _whole(value: Column) -> Column:
    """A value without the quotes that enclose it as a whole, its doubled or escaped characters restored."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    double = value.rlike(r'(?s)^"(?:[^"\\]++|""|\\.)*+"$')
    single = value.rlike(r"(?s)^'.*+(?<=')$") & (F.length(value) > 1)
    json = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
    from_json = F.when(value.rlike(r"\\u[0-9a-fA-F]{4}|\\[nt]"), F.element_at(json, 1))
    return (
        F.when(double, F.coalesce(from_json, _unescape(F.replace(inner, F.lit('""'), F.lit('"')))))
        .when(single, _unescape(F.replace(inner, F.lit("''"), F.lit("'"))))
        .otherwise(value)
    )


def _blank_quoted(item: Column, spans: Column) -> Column:
    span = F.get(spans, F.regexp_extract(item, rf"^{OPEN}(\d+){CLOSE}$", 1).try_cast("int"))
    return F.coalesce(span.rlike(rf"^([\"']){BLANK}*+\1$"), F.lit(False))


def split_packed(df: DataFrame, field: str, keys: Sequence[str], pos: str = "pos", val: str = "val") -> DataFrame:
    """One row (``keys``, ``pos`` from 1, ``val``) for each value packed in ``field``.

    Semicolons, bars and line breaks outside quotes make commas part of the
    values; so are a comma between two digits and a slash without blanks.
    Nulls, empty and blank fields give no row; a null key is kept as it is.
    Other columns of ``df`` are ignored, so names such as ``pos`` cannot clash.
    A repeated row gives its values again; an empty table gives an empty result.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    text = F.col("__text")
    # Stage by stage, as an expression that is used twice is else computed twice.
    spanned = df.select(*(col(k).alias(n) for k, n in zip(keys, names)), col(field).cast("string").alias("__text")).select(
        *names, F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)).alias("__spans"), _parts(text, SPAN).alias("__pieces")
    )
    numbered = F.transform("__pieces", lambda p, i: F.concat(p, F.when(i < F.size("__spans"), F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise("")))
    masked = spanned.select(*names, "__spans", F.regexp_replace(F.array_join(numbered, ""), rf"(?s)^{BLANK}*+\[(.*)\]{BLANK}*+$", "$1").alias("__text"))
    pieces = F.when(text.rlike(STRONG), _parts(text, SPLIT_STRONG)).otherwise(_parts(text, SPLIT_COMMA))
    split = masked.select(*names, "__spans", F.transform(pieces, _trim).alias("__items"))
    kept = split.select(*names, "__spans", F.filter("__items", lambda x: (x != "") & ~_blank_quoted(x, F.col("__spans"))).alias("__items"))
    # Each item takes its own spans along before the rows part, so no row carries the whole field.
    own = lambda x: F.transform(F.regexp_extract_all(x, F.lit(PLACE), F.lit(1)), lambda p: F.get("__spans", p.try_cast("int")))
    rows = kept.select(*names, F.posexplode(F.transform("__items", lambda x: F.struct(x.alias("item"), own(x).alias("in")))).alias("__pos", "__x"))
    item = F.col("__item")
    parted = rows.select(*names, "__pos", F.col("__x.item").alias("__item"), F.col("__x.in").alias("__in")).select(*names, "__pos", "__item", "__in", _parts(item, PLACE).alias("__texts"))
    span = F.get("__in", F.lit(0))
    mixed = F.array_join(F.transform("__texts", lambda t, i: F.concat(t, F.coalesce(_span_value(F.get("__in", i)), F.lit("")))), "")
    alone = (F.size("__in") == 1) & item.rlike(rf"^{OPEN}\d+{CLOSE}$") & span.rlike("^[\"']")
    value = F.when(F.size("__in") == 0, item).when(alone, _trim(_whole(span))).otherwise(mixed)
    return parted.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), (F.col("__pos") + 1).cast("int").alias(pos), value.alias(val))
