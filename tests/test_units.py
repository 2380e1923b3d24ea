import math

import pytest
from pyspark.sql import functions as F

from semloom.operators.units import hidden_units, resolve_units, stated_units
from semloom.session import table

ROWS = [
    (1, "5.8", "°C", None, None, "DEG_C"), (2, "300 K", "see description", None, None, "KELVIN"), (3, "18,9", None, "mg kg-1", None, "MG_KG"),
    (4, "1.2e3", None, None, "Load, unit: ln(cfu g-1)", "LN_CFU_G"), (5, "7", "https://vocab.agrisem.example/unit/PSI", None, None, "PSI"), (6, "3", "[lb.]", None, None, "LB"),
    (7, "1-11", "kg", None, None, None), (8, "c(1;2;3)", "kg", None, None, None), (9, "NaN", "kg", None, None, None), (10, "4", "spoonful", None, "batch weight 11 kg", None),
    (11, None, "kg", None, None, None), (12, "", "kg", None, None, None), (13, "560 x10³ CFU/g", None, None, None, "KCFU_G"), (14, "-12.6F", None, None, None, "DEG_F"),
    (15, "2", None, None, "Growth in broth [1/min]", "PER_MIN"), (16, "2", None, None, "Residue found in the almond in µg·kg⁻¹", "MICRO_KG"), (17, "9" * 400, "kg", None, None, None), (18, "1", None, None, "x" * 200_000, None),
]


@pytest.fixture()
def frame(spark):
    rows = [(k, v, u, l, d, None, "n", 1.0, "clash") for k, v, u, l, d, _ in ROWS]
    return spark.createDataFrame(rows, "param_key long, value string, unittext string, unit_label string, description string, unitcategory string, name string, number double, unit_from string")


def test_stated(spark, data, frame):
    ref = table(spark, data, "unit_reference")
    got = {r["param_key"]: r for r in stated_units(frame, ref, "param_key", "value", ["unittext", "unit_label"], ["description", "name"]).collect()}
    assert len(got) == len(ROWS)
    for key, *_, want in ROWS:
        assert (got[key]["unit_code"] if got[key]["number"] is not None else None) == want, key
    assert got[2]["unit_from"] == "value" and got[3]["unit_from"] == "unit_label" and got[4]["unit_from"] == "description"


def test_resolved_values(spark, data, frame):
    ref = table(spark, data, "unit_reference")
    got = {r["param_key"]: r for r in resolve_units(frame, ref, "param_key", "value", ["unittext", "unit_label"], ["description", "name"], "unitcategory").collect()}
    assert math.isclose(got[2]["common"], 26.85) and math.isclose(got[3]["common"], 18.9) and math.isclose(got[13]["common"], math.log10(560) + 3)
    assert got[10]["unit_from"] == "unknown" and got[10]["unit_code"] is None and got[10]["uncertain"]
    assert 7 not in got and 9 not in got


def test_mixture_infers_scaled_units(spark, data):
    rows = [(i, str(round(10 * 1.02 ** (i % 40), 4)), "mg", "mass") for i in range(400)]
    rows += [(1000 + i, str(round(10_000 * 1.02 ** (i % 40), 1)), None, "mass") for i in range(40)]  # micro... no unit: a thousand times larger in milligrams
    df = spark.createDataFrame([(k, v, u, None, None, c) for k, v, u, c in rows], "param_key long, value string, unittext string, unit_label string, description string, unitcategory string")
    ref = spark.createDataFrame(
        [("MG", "mass", "milligram", "mg", "GM", "none", 0.001, 0.0, "http://u/MG"), ("MICROG", "mass", "microgram", "µg", "GM", "none", 1e-6, 0.0, "http://u/MICROG")],
        "unit_code string, quantity string, unit_name string, symbol string, common_unit string, transform_name string, factor double, shift double, iri string",
    )
    got = resolve_units(df, ref, "param_key", "value", ["unittext", "unit_label"], ["description"], "unitcategory").where("param_key >= 1000").collect()
    assert {r["unit_code"] for r in got} == {"MICROG"} and all(r["posterior"] > 0.9 and not r["uncertain"] for r in got)


def test_empty(spark, data, frame):
    ref = table(spark, data, "unit_reference")
    assert resolve_units(frame.limit(0), ref, "param_key", "value", ["unittext"], ["description"], "unitcategory").count() == 0


REF_SCHEMA = "unit_code string, quantity string, unit_name string, symbol string, common_unit string, transform_name string, factor double, shift double, iri string"


def test_stated_unknown_units_stay_unknown(spark):
    ref = spark.createDataFrame([("A", "mass", "gram", "g", "A", "none", 1.0, 0.0, None), ("B", "mass", "kilogram", "kg", "A", "none", 1000.0, 0.0, None)], REF_SCHEMA)
    rows = [(i, f"{100 + i}", "g", None, "Weight of it", "mass") for i in range(40)] + [(100 + i, f"0.{100 + i}", "kg", None, "Weight of it", "mass") for i in range(40)]
    rows += [(200, "120", "spoonful", None, "Weight of it", "mass"), (201, "0.12", None, "n/a", "Weight of it", "mass"), (202, "120 boxes", None, None, "Weight of it", "mass"), (203, "130", "-", None, "Weight of it (a remark)", "mass"), (204, "130", None, None, "Weight [spoons]", "mass"), (205, "5", None, None, "Other thing", None)]
    df = spark.createDataFrame(rows, "k long, v string, u string, l string, d string, c string")
    got = {r["k"]: (r["unit_from"], r["unit_code"], r["uncertain"]) for r in resolve_units(df, ref, "k", "v", ["u", "l"], ["d"], "c").where("k >= 200").collect()}
    assert got == {200: ("unknown", None, True), 201: ("inferred", "B", False), 202: ("unknown", None, True), 203: ("inferred", "A", False), 204: ("unknown", None, True), 205: ("inferred", None, True)}
    hidden = hidden_units(df, ref, "k", "v", ["u", "l"], ["d"], "c").collect()
    assert len(hidden) == 80 and all(r["unit_code"] == r["inferred_unit"] for r in hidden if not r["uncertain"]) and sum(not r["uncertain"] for r in hidden) > 70


def test_hidden_units_of_the_tables(spark, data):
    from semloom.plans import registry

    h = registry.QUERIES["p3_hidden"](spark, data.replace("0.001", "0.01")).where("not uncertain").agg(F.sum("n"), F.sum("n_right")).first()
    assert h[0] > 100 and h[1] / h[0] >= 0.95
