"""Exact selection against sorting."""

import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.operators import selection as S

SCHEMA = "g string, h int, x double"


@pytest.mark.parametrize("seed", range(3))
def test_medians(spark, seed):
    """Odd and even counts, ties, one value in a third of all rows, null keys and values, a key of nulls alone, one row."""
    rng = random.Random(seed)
    rows = [("nulls", 1, None), (None, None, 4.5), ("one", 2, -1e-300)]
    for g in ("a", "b", None):
        for h in (1, None):
            for _ in range(rng.randrange(2, 200)):
                rows.append((g, h, rng.choice([7.25, rng.gauss(0, 1e-3), rng.gauss(0, 1e8), float(rng.randrange(-3, 3)), None])))
    own: dict = {}
    for g, h, x in rows:
        own.setdefault((g, h), []).append(x)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["g"], r["h"]): r["median"] for r in S.median(df, "x", ["g", "h"]).collect()}
    want = {k: statistics.median(v) if (v := [x for x in xs if x is not None]) else None for k, xs in own.items()}
    assert got == want


def test_any_ranks(spark):
    x = [random.Random(1).gauss(0, 10) for _ in range(500)]
    df = spark.createDataFrame([("a", 1, v) for v in x], SCHEMA)
    got = {r["rank"]: r["x"] for r in S.order_statistics(df, "x", ["g"], F.array(*map(F.lit, (1, 2, 250, 499, 500, 501, 0))).cast("array<long>")).collect()}
    assert got == {k: sorted(x)[k - 1] for k in (1, 2, 250, 499, 500)}


def test_order_of_special_values(spark):
    special = [-math.inf, -1e308, -5e-324, -0.0, 0.0, 5e-324, 1.0, math.inf, math.nan]
    bits = S.ordered_bits.func(pd.Series(special)).tolist()
    assert bits[3] == bits[4] and bits[:4] == sorted(bits[:4]) and bits[4:] == sorted(bits[4:]) and len(set(bits)) == 8
    df = spark.createDataFrame([("a", 1, v) for v in special], SCHEMA)
    assert S.median(df, "x", ["g"]).first()["median"] == 0.0
    assert math.isnan(S.order_statistics(df, "x", ["g"], F.array(F.col("n"))).first()["x"])


def test_no_rows_and_no_keys(spark):
    assert S.median(spark.createDataFrame([], SCHEMA), "x", ["g"]).count() == 0
    df = spark.createDataFrame([("a", 1, float(v)) for v in range(10)], SCHEMA)
    assert S.order_statistics(df, "x", [], F.array(F.lit(4).cast("long"))).first()["x"] == 3.0
