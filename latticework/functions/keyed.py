"""Joins on keys of which nulls are values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with those of the same key, nulls included; without keys, all with all of `other`, which is then a single row."""
    named = other.withColumnsRenamed({k: f"_other{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_other{i}"))
    return df.join(named, same).drop(*[f"_other{i}" for i in range(len(keys))])
