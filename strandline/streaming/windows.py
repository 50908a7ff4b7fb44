"""Extension: mean and variance of a stream by key and time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, key: str, at: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number, mean and sample variance (0 for one row) of each key and window; state is a few numbers a key and open window."""
    rows = stream.withWatermark(at, late)
    stats = rows.groupBy(F.window(at, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))
    return stats.select(F.col("window.start").alias("start"), key, "n", "mean", "var")
