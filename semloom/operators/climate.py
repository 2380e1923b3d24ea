"""Gridded series and regions: calendar buckets, weighted means, statistics, units, boxes, polygons, rotated poles (A1-A6, F14, G1-G7)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: Column, freq: str) -> Column:
    """A1. Label of the calendar bucket: the day, the week's Sunday, the month's or the year's last day."""
    day = F.to_date(ts)
    week = F.date_add(F.to_date(F.date_trunc("week", day.cast("timestamp"))), 6)
    year = F.make_date(F.year(day), F.lit(12), F.lit(31))
    return {"D": day, "W": week, "M": F.last_day(day), "Y": year}[freq]


def number(c: Column) -> Column:
    """A6. NaN as null, so that it drops out of aggregates."""
    return F.when(~F.isnan(c), c)


def resample(df: DataFrame, ts: str, value: str, freq: str, keys: Sequence[str] = (), fill: bool = False) -> DataFrame:
    """A1. Mean of each bucket (and keys); ``fill`` adds empty buckets between the first and the last."""
    out = df.select(*keys, bucket(F.col(ts), freq).alias("bucket"), number(F.col(value).cast("double")).alias("v")).where("bucket is not null").groupBy(*keys, "bucket").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    if not fill:
        return out
    step = {"D": "1 day", "W": "7 day", "M": "1 month", "Y": "1 year"}[freq]
    span = out.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    first = F.trunc("a", "month") if freq == "M" else F.col("a")
    days = F.sequence(first, F.col("b"), F.expr(f"interval {step}"))
    days = F.transform(days, F.last_day) if freq == "M" else days
    calendar = span.select(*keys, F.explode(days).alias("bucket"))
    return calendar.join(out, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted_mean(value: Column, latitude: Column | None) -> Column:
    """A2. Mean weighted by the cosine of the latitude; missing cells drop out of both sums; plain where there is no latitude."""
    v = number(value)
    if latitude is None:
        return F.avg(v)
    w = F.cos(F.radians(latitude))
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """A3. Count, mean, 10th and 90th percentile (interpolated), least and greatest of finite values."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    base = df.select(*keys, v.alias("v"))
    return base.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def to_celsius(df: DataFrame, value: str, units: str | None = None, limit: float = 200.0) -> DataFrame:
    """A5. From kelvin where the units say so or the mean of all values is above ``limit``."""
    kelvin = (units or "").strip().lower() in ("k", "kelvin")
    mean = df.agg(F.avg(number(F.col(value)))).scalar()
    warm = F.lit(True) if kelvin else F.coalesce(mean > limit, F.lit(False))
    return df.withColumn(value, F.when(warm, F.col(value) - 273.15).otherwise(F.col(value)))


def in_days(ts: Column, first: str, last: str) -> Column:
    """F14. From the first day's midnight to the end of the last day."""
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


def valid_years(df: DataFrame, year: str, experiment: str, ranges: DataFrame) -> DataFrame:
    """F15. Rows whose year lies in the range (experiment, first_year, last_year) of their experiment."""
    return df.join(ranges.withColumnRenamed("experiment", experiment), experiment).where(F.col(year).between(F.col("first_year"), F.col("last_year"))).drop("first_year", "last_year")


def bbox(wkt: Column) -> Column:
    """G1/A15. Struct (n, w, s, e) of the coordinates of a WKT geometry."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(0))
    x = F.transform(pairs, lambda p: F.element_at(F.split(p, r"\s+"), 1).cast("double"))
    y = F.transform(pairs, lambda p: F.element_at(F.split(p, r"\s+"), 2).cast("double"))
    return F.struct(F.array_max(y).alias("n"), F.array_min(x).alias("w"), F.array_min(y).alias("s"), F.array_max(x).alias("e"))


def pad(b: Column, degrees: float) -> Column:
    """G2."""
    return F.struct((b["n"] + degrees).alias("n"), (b["w"] - degrees).alias("w"), (b["s"] - degrees).alias("s"), (b["e"] + degrees).alias("e"))


def sane(b: Column) -> Column:
    """G3. Latitudes within 90 degrees, longitudes from -180 to 180, north above south, east beyond west."""
    lat = lambda c: F.greatest(F.least(c, F.lit(90.0)), F.lit(-90.0))
    lon = lambda c: F.pmod(c + 180, F.lit(360.0)) - 180
    n, s, w, e = lat(b["n"]), lat(b["s"]), lon(b["w"]), lon(b["e"])
    return F.struct(F.greatest(n, s).alias("n"), F.least(w, e).alias("w"), F.least(n, s).alias("s"), F.greatest(w, e).alias("e"))


def at_least(b: Column, span: float = 0.05) -> Column:
    """G4. A box at least ``span`` high and wide, about its middle."""
    tall, wide = (b["n"] - b["s"]) >= span, (b["e"] - b["w"]) >= span
    lat, lon = (b["n"] + b["s"]) / 2, (b["e"] + b["w"]) / 2
    return F.struct(
        F.when(tall, b["n"]).otherwise(lat + span / 2).alias("n"), F.when(wide, b["w"]).otherwise(lon - span / 2).alias("w"), F.when(tall, b["s"]).otherwise(lat - span / 2).alias("s"), F.when(wide, b["e"]).otherwise(lon + span / 2).alias("e")
    )


def rings(wkt: str) -> list[list[tuple[float, float]]]:
    """The rings of a POLYGON or MULTIPOLYGON."""
    import re

    out = []
    for ring in re.findall(r"\(([^()]+)\)", wkt or ""):
        points = [tuple(map(float, p.split()[:2])) for p in ring.split(",")]
        out.append(points)
    return out


def inside(x: pd.Series, y: pd.Series, polygon: list[list[tuple[float, float]]]) -> pd.Series:
    """Even-odd rule over all rings, so holes count; points on an edge may fall either side."""
    hit = pd.Series(False, index=x.index)
    for ring in polygon:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if y0 == y1:
                continue
            crosses = (y0 > y) != (y1 > y)
            hit = hit ^ (crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return hit


def clip(grid: DataFrame, regions: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """G5/J-spatial. Grid rows with the key of each region (region, wkt) that holds the cell's centre.

    Only distinct cells are tested; cells meet regions by the whole degrees their
    boxes cover, and only these pairs reach the polygon test.
    """
    box = regions.withColumn("b", bbox(F.col("wkt"))).where("b.n is not null")
    cover = box.select("region", "wkt", F.explode(F.sequence(F.floor("b.w"), F.floor("b.e"))).alias("cx"), "b").select("region", "wkt", "cx", F.explode(F.sequence(F.floor("b.s"), F.floor("b.n"))).alias("cy"))
    cells = grid.select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct().withColumns({"cx": F.floor("__x"), "cy": F.floor("__y")})

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for wkt, part in b.groupby("wkt"):
                yield part[inside(part["__x"], part["__y"], rings(wkt))][["region", "__x", "__y"]]

    kinds = dict(grid.dtypes)
    found = cells.join(cover, ["cx", "cy"]).select("region", "wkt", "__x", "__y").mapInPandas(test, f"region string, __x {kinds[x]}, __y {kinds[y]}")
    return grid.join(found, (grid[x] == found["__x"]) & (grid[y] == found["__y"])).drop("__x", "__y")


def from_rotated(rlat: Column, rlon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """G6. (latitude, longitude) of a cell centre of a grid with a rotated pole, in closed form (no resampling)."""
    p = math.radians(pole_lat)
    lat, lon = F.radians(rlat), F.radians(rlon)
    out_lat = F.degrees(F.asin(math.sin(p) * F.sin(lat) + math.cos(p) * F.cos(lat) * F.cos(lon)))
    out_lon = F.degrees(F.atan2(F.cos(lat) * F.sin(lon), math.sin(p) * F.cos(lat) * F.cos(lon) - math.cos(p) * F.sin(lat))) + pole_lon + 180
    return out_lat, F.pmod(out_lon + 180, F.lit(360.0)) - 180


def time_scales(first: Column, last: Column) -> Column:
    """G7. The scales that a span of days allows."""
    days = F.date_diff(last, first)
    return F.filter(F.array(F.lit("D"), F.when(days > 7, "W"), F.when(days > 30, "M"), F.when(days > 365, "Y")), lambda s: s.isNotNull())
