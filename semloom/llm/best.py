"""Best representative of each duplicate group: skyline layers over completeness, recency and trust.

A record is dominated where another of its group is at least as complete in
every field, at least as late and at least as trusted, and better in one of
these. Records are shuffled once, by group, without their values, and reduced
there to one per *cell* (group, completeness of each field, trust): the latest,
then of smallest id. Rows of hot groups, found by counting hashes of the first
group column, are reduced to cells before the shuffle too, so no task ever holds
a hot group. The cells of a group are peeled into dominance layers by array
expressions. Values are fetched at the end, for the chosen rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semloom.session import col, computed

EMPTY = r"^[\s\u0085  -​ 　﻿]*+(?:-|(?i:n/a))?[\s\u0085  -​ 　﻿]*+$"
CUT = r"(?:…|\.\.\.)[\s ]*+$"


def completeness(field: Column, cut_counts: bool = False) -> Column:
    """0 for null, blank, '-' and 'N/A', 1 for a text cut off with an ellipsis where that counts, 2 for any other value."""
    rest = F.when(field.rlike(CUT), 1).otherwise(2) if cut_counts else F.lit(2)
    return F.when(field.isNull() | field.rlike(EMPTY), 0).otherwise(rest).cast("tinyint")


def concept_of(uri: Column, ident: Column) -> Column:
    """What a record denotes: the local name of its uri, or its id where the uri is blank.

    Scheme, case of the host, query, fragment, closing slash, blanks around and
    percent encoding of a uri don't tell concepts apart. Null where both are blank.
    """
    plain = F.regexp_replace(F.regexp_replace(uri, r"^[\s ]+|[\s ]+$", ""), r"[?#].*$|/+$", "")
    name = F.regexp_extract(F.regexp_replace(plain, "/+$", ""), r"([^/]+)$", 1)
    decoded = F.when(name.contains("%"), F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)).otherwise(name)
    own = F.nullif(F.trim(ident), F.lit(""))
    return F.when(uri.isNull() | uri.rlike(EMPTY), own).otherwise(decoded)


#: Hashes of the first group column that are counted, and from how many rows of one hash on its groups are reduced before the shuffle.
HASHES, HOT = 1 << 16, 20_000


def skyline_layers(df: DataFrame, group: Mapping[str, Column], row_id: str, fields: Sequence[str], recency: str, trust: str, cut: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """One row per group of two rows or more: the group's columns, ``group_id`` (smallest row id), ``n_rows`` and ``cells``.

    ``cells`` is an array of structs (layer from 1, row_id, completeness of each
    field as c0.., recency, trust), in the order of the lexicographic policy:
    completeness field by field, then the latest, the most trusted (smallest
    ``trust``) and the smallest id. A null recency is the earliest, a null trust
    the least. Rows whose group has a null column belong to no group. Equal rows
    fall in one cell, the smallest id stands for them. Other columns are ignored,
    so their names can't clash. A group has at most 3 cells per field and value of
    ``trust``, which is to have few values.
    """
    g, c = [f"__g{i}" for i in range(len(group))], [f"c{i}" for i in range(len(fields))]
    bucket = F.pmod(F.hash(next(iter(group.values()))), F.lit(HASHES))
    # At most HASHES rows, whatever the data.
    many = F.broadcast(df.groupBy(bucket.alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select("__h"))
    marked = df.withColumn("__h", bucket)

    def read(rows: DataFrame) -> DataFrame:
        code = F.lit(0)
        for f in fields:
            code = code * 3 + completeness(col(f), f in cut).cast("int")
        return computed(
            rows, *(e.alias(n) for e, n in zip(group.values(), g)), (-col(row_id).cast("long")).alias("i"), F.coalesce(F.unix_micros(col(recency).cast("timestamp")), F.lit(-(2**62))).alias("r"),
            F.coalesce(col(trust).cast("int"), F.lit(2**31 - 1)).alias("__t"), code.alias("__c"),
        ).dropna(subset=g)

    best = F.max(F.struct("r", "i")).alias("b")
    cold = read(marked.join(many, "__h", "left_anti")).withColumns({"n": F.lit(1).cast("long"), "m": -F.col("i")})
    reduced = read(marked.join(many, "__h", "left_semi")).groupBy(*g, "__t", "__c").agg(best, F.count(F.lit(1)).alias("n"), F.min(-F.col("i")).alias("m")).select(*g, F.col("b.i").alias("i"), F.col("b.r").alias("r"), "__t", "__c", "n", "m")
    # Rows of a group are together from here on, so neither grouping shuffles again.
    cells = cold.unionByName(reduced).repartition(*g).groupBy(*g, "__t", "__c").agg(best, F.sum("n").alias("n"), F.min("m").alias("m"))
    digits = [F.pmod(F.floor(F.col("__c") / 3 ** (len(fields) - 1 - k)), F.lit(3)).cast("tinyint").alias(n) for k, n in enumerate(c)]
    cell = F.struct(*digits, F.col("b.r").alias("r"), (-F.col("__t")).alias("t"), F.col("b.i").alias("i"))
    groups = cells.groupBy(*g).agg(F.min("m").alias("group_id"), F.sum("n").alias("n_rows"), F.collect_list(cell).alias("__cells")).where("n_rows > 1")
    sorted_ = groups.select(*g, "group_id", "n_rows", F.reverse(F.array_sort("__cells")).alias("__cells"))

    def covers(y: Column, x: Column) -> Column:
        out = (y["r"] >= x["r"]) & (y["t"] >= x["t"])
        for n in c:
            out = out & (y[n] >= x[n])
        return out

    kind = "array<struct<layer:int," + ",".join(f"{n}:tinyint" for n in c) + ",r:bigint,t:int,i:bigint>>"

    def placed(done: Column, x: Column) -> Column:
        # What dominates a cell comes before it in this order, so one pass gives all layers.
        above = F.aggregate(done, F.lit(0), lambda m, y: F.greatest(m, F.when(covers(y, x), y["layer"]).otherwise(0)))
        return F.concat(done, F.array(F.struct((above + 1).alias("layer"), *(x[n].alias(n) for n in (*c, "r", "t", "i")))))

    layered = F.aggregate("__cells", F.array().cast(kind), placed)
    out = F.transform(layered, lambda x: F.struct(x["layer"].alias("layer"), (-x["i"]).alias("row_id"), *(x[n].alias(n) for n in c), x["r"].alias("recency"), (-x["t"]).alias("trust")))
    return computed(sorted_, *(F.col(n).alias(k) for n, k in zip(g, group)), "group_id", "n_rows", out.alias("cells"))


def survivors(layers: DataFrame) -> DataFrame:
    """(group_id, survivor_id): the record that no other of its group beats in anything.

    There is one exactly where the first layer is a single cell; of equal records the smallest id survives.
    """
    first = F.filter("cells", lambda x: x["layer"] == 1)
    return layers.where(F.size(first) == 1).select("group_id", F.element_at(first, 1)["row_id"].alias("survivor_id"))


def best_records(layers: DataFrame, df: DataFrame, row_id: str, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One record per group: the first of the skyline by the lexicographic policy, its gaps filled from the layers below.

    A field takes the fullest value of the first layer that has any; within a
    layer the policy decides. The values are fetched from ``df`` by the ids of
    the rows that were chosen. A field that no record of the group fills is null.
    """

    def source(i: int) -> Column:
        filled = F.filter("cells", lambda x: x[f"c{i}"] > 0)
        return F.array_min(F.transform(filled, lambda x, k: F.struct((-x[f"c{i}"]).alias("c"), x["layer"].alias("l"), k.alias("k"), x["row_id"].alias("id"))))["id"]

    first = F.array_min(F.transform("cells", lambda x, k: F.struct(x["layer"].alias("l"), k.alias("k"), x["row_id"].alias("id"))))
    chosen = computed(layers, *(col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("group_id").alias("__group"), F.col("n_rows").alias("__n"), first["id"].alias("__s"), F.array(*map(source, range(len(fields)))).alias("__from"))
    asked = chosen.withColumn("__id", F.explode(F.array_distinct(F.concat(F.array("__s"), F.filter("__from", lambda x: x.isNotNull())))))
    values = df.select(col(row_id).cast("long").alias("__id"), *(col(f).alias(f"__v{i}") for i, f in enumerate(fields)))
    met = asked.join(values, "__id")
    keys = [f"__g{i}" for i in range(len(group))]
    taken = [F.max(F.when(F.get("__from", F.lit(i)) == F.col("__id"), F.col(f"__v{i}"))).alias(f"best_{f}") for i, f in enumerate(fields)]
    out = met.groupBy("__group").agg(*(F.first(k).alias(k) for k in keys), F.first("__n").alias("n_rows"), F.first("__s").alias("survivor_id"), *taken)
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), F.col("__group").alias("group_id"), "n_rows", "survivor_id", *(f"best_{f}" for f in fields))
