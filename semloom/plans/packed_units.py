"""Queries of the general problems: packed fields and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators.packed import split_packed
from semloom.operators.units import hidden_units, resolve_units
from semloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "master_mapping"), "altlabels", ["row_id"])


def _units(spark: SparkSession, sf_dir: str, operator=resolve_units) -> DataFrame:
    return operator(
        table(spark, sf_dir, "model_parameter"), table(spark, sf_dir, "unit_reference"), "param_key", "value",
        fields=["unittext", "unit_label"], texts=["description", "name"], category="unitcategory",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the resolved values those whose unit is stated, in thousandths of the common unit."""
    stated = _units(spark, sf_dir).where("unit_from not in ('inferred', 'unknown') and common is not null")
    return stated.select("param_key", "common_unit", F.rint(F.col("common") * 1000).cast("long").alias("value_milli"))


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All resolved values, with inferred units, their posterior and the mark of doubt."""
    return _units(spark, sf_dir)


def p3_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference measured: every stated unit hidden in turn; rows, right units and mean posterior by quantity and tenth of the posterior."""
    h = _units(spark, sf_dir, hidden_units)
    tenth = F.least(F.floor(F.col("posterior") * 10), F.lit(9)).cast("int")
    right = (F.col("inferred_unit") == F.col("unit_code")) & (F.col("inferred_quantity") == F.col("quantity"))
    return h.groupBy("quantity", tenth.alias("tenth"), "uncertain").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.round(F.avg("posterior"), 4).alias("posterior"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_units": p3_units, "p3_hidden": p3_hidden}
SQL: dict[str, str] = {}
