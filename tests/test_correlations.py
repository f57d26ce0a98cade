"""Correlations of values far from 0, odd vectors and merged blocks."""

import math

import numpy as np
import pytest

from latticework.operators import graph as G


def test_large_offsets_cost_no_digits(spark):
    x = np.random.default_rng(1).normal(size=(400, 5)) + np.array([1e6, -1e7, 0, 5e5, 1e4])
    x[:, 4] += 0.5 * x[:, 0]
    df = spark.createDataFrame([(k % 2, v.tolist()) for k, v in enumerate(x)], "g int, v array<double>").repartition(7)
    for r in G.correlations(df, "v", ["g"]).collect():
        own = x[r["g"] :: 2]
        assert r["w"] == pytest.approx(np.corrcoef(own[:, r["i"]], own[:, r["j"]])[0, 1], abs=2e-9)


def test_odd_vectors(spark):
    rows = [("a", [1.0, 2.0, 7.0]), ("a", [2.0, 1.0, 7.0]), ("a", [3.0, 0.0, 7.0]), ("a", [1.0, 9.0]), ("a", None), ("a", [1.0, None, 3.0]), ("a", [math.nan, 1.0, 2.0]), ("a", []), (None, [1.0, 2.0]), (None, [2.0, 4.0]), ("c", [5.0])]
    got = {(r["g"], r["i"], r["j"]): r["w"] for r in G.correlations(spark.createDataFrame(rows, "g string, v array<double>"), "v", ["g"]).collect()}
    assert got == {("a", 0, 1): -1.0, ("a", 0, 2): None, ("a", 1, 2): None, (None, 0, 1): 1.0}
    assert G.correlations(spark.createDataFrame([], "g string, v array<double>"), "v", ["g"]).count() == 0
