"""Tables behind box plots and bars: exact quartiles, whiskers, outliers, means and their errors, for many groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.keyed import same_keys
from latticework.operators.selection import order_statistics

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
#: Boxes' lengths that a whisker spans at most, and the deviations of a mean's 95 % interval.
REACH, NORMAL = 1.5, 1.96


def _place(share: float) -> Column:
    """Where a share of the values lies, in places from 1: the middle of the first value's own share is at 1."""
    return F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * share + 0.5))


def box_table(df: DataFrame, value: str, keys: Sequence[str], reach: float = REACH) -> DataFrame:
    """keys, n, mean, sd, lo95, hi95, q1, median, q3, low, high, n_outliers of each key's values; nulls and NaN take no part, and a key without other values has no row.

    Quartiles are exact (order_statistics sorts nothing and holds no group), between two values linearly. Whiskers, low
    and high, are the outermost values within `reach` boxes of the box; what lies beyond is an outlier. Deviation and
    interval of a single value are null. Null keys are a key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    floors = [F.floor(_place(p)).cast("long") for p in QUARTILES.values()]
    ranks = F.array(*floors, *[F.least(f + 1, F.col("n")) for f in floors])
    found = order_statistics(rows, "_v", keys, ranks).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_at"))  # six places at most
    box = same_keys(base, found, keys)
    for name, share in QUARTILES.items():
        at, first = _place(share), F.floor(_place(share)).cast("long")
        lower, upper = F.col("_at")[first], F.col("_at")[F.least(first + 1, F.col("n"))]
        box = box.withColumn(name, lower + (at - first) * (upper - lower))
    half = NORMAL * F.col("sd") / F.sqrt("n")
    fence = F.lit(reach) * (F.col("q3") - F.col("q1"))
    box = box.withColumns({"lo95": F.col("mean") - half, "hi95": F.col("mean") + half, "_lo": F.col("q1") - fence, "_hi": F.col("q3") + fence}).drop("_at")
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    ends = same_keys(rows, box.select(*keys, "_lo", "_hi"), keys).groupBy(*keys).agg(F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.count_if(~inside).alias("n_outliers"))
    return same_keys(box, ends, keys).select(*keys, "n", "mean", "sd", "lo95", "hi95", *QUARTILES, "low", "high", "n_outliers")

