"""Exact order statistics of many groups at once: radix narrowing over the order-preserving bits of doubles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from latticework.session import kept

#: Bits told apart a round; 2 ** DIGIT counts a group and round at most.
DIGIT = 13


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A long for each double, in the same order; both zeros are one value, NaN is above all."""
    v = x.to_numpy(float) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _steps() -> list[tuple[int, int]]:
    """(bits below a digit, bits of the digit), highest first, over all 64 bits."""
    out, left = [], 64
    while left:
        width = min(DIGIT, left)
        left -= width
        out.append((left, width))
    return out


def order_statistics(df: DataFrame, value: str, keys: Sequence[str], ranks: Column) -> DataFrame:
    """keys, rank, value: the values at the `ranks`, an array of places from 1 worked out from `n`, of each key's non-null values.

    Nothing is sorted and no key's values meet. Each round counts, for all keys together, how many values with a wanted
    prefix have which next digit; partial counts are added before they move, so a round shuffles a row for each task, key
    and digit at most, and the digit that holds the wanted place lengthens the prefix. After the first round only rows
    with a wanted prefix are written and read again; 64 bits take five rounds, whatever the row count. Keys may be many
    or few: prefixes are joined to rows as Spark sees fit, and null keys are keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_x"))
    rows = kept(rows.withColumn("_b", ordered_bits("_x")), "selection")
    n = rows.groupBy(*names).agg(F.count("*").alias("n"))
    wanted = kept(n.withColumn("_rank", F.explode(F.array_distinct(ranks))).filter("_rank between 1 and n").select(*names, "_rank", F.col("_rank").alias("_left"), F.lit(0).cast("long").alias("_prefix")), "targets")

    def joined(rows: DataFrame, targets: DataFrame, below: int, first: bool) -> DataFrame:
        other = targets.select(*[F.col(n).alias(f"{n}t") for n in names], "_rank", "_left", "_prefix")
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}t"))
        if not first:
            same = same & (F.shiftright("_b", below) == F.col("_prefix"))
        return rows.join(other, same).drop(*[f"{n}t" for n in names])

    for first, (below, width) in zip([True, *[False] * 9], _steps(), strict=False):
        digit = F.shiftright("_b", below) if first else F.shiftright("_b", below).bitwiseAND((1 << width) - 1)
        counted = joined(rows, wanted, below + width, first).groupBy(*names, "_rank", "_left", "_prefix", digit.alias("_digit")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*names, "_rank").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        hit = counted.withColumn("_upto", upto).filter("_upto >= _left and _upto - _n < _left")
        prefix = F.col("_digit") if first else F.shiftleft("_prefix", width).bitwiseOR(F.col("_digit"))
        wanted = kept(hit.select(*names, "_rank", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), prefix.alias("_prefix")), "targets")
        if first:
            distinct = wanted.groupBy(*names, "_prefix").agg(F.min("_rank").alias("_rank"), F.min("_left").alias("_left"))
            rows = kept(joined(rows, distinct, below, False).select(*names, "_x", "_b"), "selection")
    values = joined(rows, wanted, 0, False).groupBy(*names, "_rank").agg(F.min("_x").alias(value))
    return values.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_rank").alias("rank"), value)


def median(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, median: the middle value of each key, the mean of the two middle ones of an even count; nulls take no part, a key of nulls alone has a null median."""
    half = F.array(((F.col("n") + 1) / 2).cast("long"), (F.col("n") / 2).cast("long") + 1)
    of = order_statistics(df, value, keys, half).groupBy(*keys).agg(F.avg(value).alias("median"))
    other = of.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "median")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return df.select(*keys).distinct().join(other, same, "left").select(*keys, "median")


def matrix_median(conn: DataFrame, unit: Sequence[str], keys: Sequence[str], value: str = "w") -> DataFrame:
    """keys, median: over all cells of all full matrices of each key, which have both triangles of the pairs (unit, i, j, value) and zeros on the diagonal; NaN and nulls take no part.

    `unit` tells matrices apart and includes the keys.
    """
    cell = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    triangles = conn.select(*keys, F.explode(F.array_repeat(cell, 2)).alias("_cell"))
    diagonal = conn.select(*unit, F.explode(F.array("i", "j")).alias("_node")).distinct().select(*keys, F.lit(0.0).alias("_cell"))
    return median(triangles.unionByName(diagonal), "_cell", keys)
