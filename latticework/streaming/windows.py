"""Epochs over streams: tumbling windows with a watermark; the same call serves batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_windows(df: DataFrame, time: str, value: str, keys: list[str], length: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """keys, start, n, mean and variance of each tumbling window. On a stream, rows later than `late` are dropped and windows end with the watermark."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean", "variance")
