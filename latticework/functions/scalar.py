"""Column expressions: decibels, rescaling, colour indices, percentages, Legendre polynomials, p-values' parts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def r9(c: Column) -> Column:
    return F.round(c.cast("double"), 9)


def decibel(power: Column) -> Column:
    return 10 * F.log10(F.when(power > 0, power))


def rescale(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo), not below 0; null where lo equals hi."""
    return F.greatest((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))


def colour_index(x: Column, n: int) -> Column:
    return F.least(F.greatest(F.round(x * n), F.lit(1.0)), F.lit(float(n))).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0))


def missing_to_zero(x: Column) -> Column:
    """NaN and null to 0."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def legendre(x: Column, terms: int = 7) -> list[Column]:
    """P_1 to P_terms by their recurrence."""
    out = [F.lit(1.0), x]
    for n in range(1, terms):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return out[1:]


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(DoubleType())
def chi2_one_df(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore")
