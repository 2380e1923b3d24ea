"""A keyed cache with a time to live, as a table (C1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_DAYS = 7


def active(cache: DataFrame, now, days: int = TTL_DAYS) -> DataFrame:
    """Entries whose ``cached_at`` is at most ``days`` old; null counts as expired."""
    return cache.where(F.col("cached_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def lookup(wanted: DataFrame, cache: DataFrame, key: str, now, days: int = TTL_DAYS) -> DataFrame:
    """Wanted keys with their cached value, null where there is none or it expired."""
    return wanted.join(active(cache, now, days).select(key, "value", "cached_at"), key, "left")


def put(cache: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The cache with entries added; of one key the latest stands."""
    both = cache.unionByName(entries)
    return both.groupBy(key).agg(F.max_by(F.struct(*(c for c in cache.columns if c != key)), "cached_at").alias("v")).select(key, "v.*").select(*cache.columns)


def removed(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The cache without some keys."""
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def stats(cache: DataFrame, now, days: int = TTL_DAYS) -> DataFrame:
    """One row (total, active, expired)."""
    fresh = F.coalesce(F.col("cached_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(False))
    return cache.agg(F.count(F.lit(1)).alias("total"), F.count_if(fresh).alias("active"), F.count_if(~fresh).alias("expired"))


def memoised(df: DataFrame) -> DataFrame:
    """C2. The result kept by executors, on disk where memory is short; ``unpersist`` lets it go. What is lost with an executor is computed again."""
    return df.persist()


def format_counts(results: DataFrame, kind: str, ok: str) -> DataFrame:
    """A9. (kind, total, succeeded, failed) of a table of results."""
    return results.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))
