"""Pairs of texts one of which holds the other, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(c: Column, n: int) -> Column:
    """The distinct pieces of ``n`` letters of a text; none where it is shorter."""
    places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1)))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(n)))), F.array().cast("array<string>"))


def holding(outer: DataFrame, text: str, inner: DataFrame, part: str, piece: int = 3) -> DataFrame:
    """All columns of both sides where ``outer.text`` holds ``inner.part`` (equal texts too; a null or empty part is in none).

    The first ``piece`` letters of the part (all of a shorter part) are one of
    the pieces of the text, so this is an equi-join on pieces that is verified
    after. Both sides may be of any size; column names must differ.
    """
    held = inner.where(F.length(part) > 0).withColumn("__g", F.substring(part, 1, piece))
    long_, short = held.where(F.length("__g") == piece), held.where(F.length("__g") < piece)
    few = F.flatten(F.array(*(grams(F.col(text), n) for n in range(1, piece))))
    by_long = outer.withColumn("__g", F.explode(grams(F.col(text), piece))).join(long_, "__g")
    by_short = outer.withColumn("__g", F.explode(few)).join(short, "__g")
    return by_long.unionByName(by_short).drop("__g").where(F.col(text).contains(F.col(part)))
