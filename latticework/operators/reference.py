"""Small reference tables: bands, densities, time constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Band edges in Hz.
BANDS = [(1, "delta", 0.0, 4.0), (2, "theta", 4.0, 8.0), (3, "alpha", 8.0, 13.0), (4, "beta", 13.0, 30.0), (5, "gamma", 30.0, 45.0)]


def bands(spark: SparkSession, rows=BANDS) -> DataFrame:
    return spark.createDataFrame(rows, "band int, name string, lo double, hi double")


def thresholds(spark: SparkSession) -> DataFrame:
    """37 densities from 1 down to 0.1; t_idx is the key, density an exact decimal."""
    return spark.range(37).select(F.col("id").cast("int").alias("t_idx"), ((1000 - 25 * F.col("id")).cast("decimal(7,3)") / 1000).cast("decimal(4,3)").alias("density"))


def density_range(t: DataFrame, lo: str = "0.1", hi: str = "0.9") -> DataFrame:
    return t.filter(F.col("density").between(F.lit(lo).cast("decimal(4,3)"), F.lit(hi).cast("decimal(4,3)")))


def nearest_density(t: DataFrame, wanted: float) -> DataFrame:
    """The density closest to the wanted one, the first of equals."""
    return t.orderBy(F.round(F.abs(F.col("density").cast("double") - wanted), 9), "t_idx").limit(1)


def time_constant_hz(taus, rate: float, kernel: int = 3) -> list[float]:
    return [rate / kernel / t for t in taus]
