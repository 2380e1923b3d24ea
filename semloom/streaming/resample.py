"""The temporal mean over a stream: an extension, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_resample(stream: DataFrame, ts: str, value: str, width: str = "1 day", late: str = "2 days", keys: Sequence[str] = ()) -> DataFrame:
    """A1 over a stream: mean and count of each window (and keys) once no row of it can come any more; rows later than ``late`` are left out."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    timed = stream.withColumns({ts: F.col(ts).cast("timestamp"), "__v": v}).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.avg("__v").alias("mean"), F.count("__v").alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *keys, "mean", "n")
