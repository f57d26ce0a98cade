"""Rank statistics from range-partitioned counts against all pairs of values, one at a time."""

import itertools
import math
import random

import pytest

from latticework.operators import ranks as R
from latticework.operators import stats as T

SCHEMA = "feature string, grp int, score double"


def plain(rows):
    out = {}
    scores: dict = {}
    for f, g, s in rows:
        if g is not None and s is not None:
            scores.setdefault(f, {}).setdefault(g, []).append(s)
    for f, own in scores.items():
        for g0, g1 in itertools.combinations(sorted(own), 2):
            a, b = own[g0], own[g1]
            u = sum((y > x) + (y == x) / 2 for x in a for y in b)
            ties = sum(t**3 - t for v in set(a + b) for t in [(a + b).count(v)])
            best = max(set(a + b), key=lambda v: (abs(sum(y >= v for y in b) * len(a) - sum(x >= v for x in a) * len(b)), v))
            out[f, g0, g1] = (len(a), len(b), u, ties, best, sum(x >= best for x in a), sum(y >= best for y in b), a.count(best), b.count(best))
    return out


def found(df, keys=("feature",)):
    return {(r["feature"], r["g0"], r["g1"]): tuple(r[c] for c in ("n0", "n1", "u", "ties", "threshold", "fp_at", "tp_at", "at0", "at1")) for r in R.pair_ranks(df, list(keys)).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs(spark, seed):
    """Many ties and few, groups that some features lack, nulls, a null feature, one value that holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for f in ["a", "b", None, "c"]:
        for _ in range(rng.randrange(1, 120)):
            value = 3.0 if rng.random() < 0.33 else rng.choice([float(rng.randrange(6)), rng.gauss(2, 2)])
            rows.append((f, rng.choice([0, 1, 2, 7, None] if f != "b" else [1, 7]), rng.choice([value, value, value, None])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == plain(rows)


def test_blocks_of_any_size_add_up(spark):
    """One feature over many range partitions, so that every pair counts across blocks."""
    rng = random.Random(8)
    rows = [("a", rng.randrange(3), round(rng.gauss(0, 1) + 0.2 * (k % 3), 2)) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_is_ranked_in_one_task(spark):
    df = spark.createDataFrame([("a", k % 2, float(k)) for k in range(20)], SCHEMA)
    plan = T.rank_statistics(R.pair_ranks(df, ["feature"]), ["feature"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" in plan and "Generate" not in plan


def test_odd_tables(spark):
    assert R.pair_ranks(spark.createDataFrame([], SCHEMA), ["feature"]).count() == 0
    assert R.pair_ranks(spark.createDataFrame([("a", 1, 2.0)], SCHEMA), ["feature"]).count() == 0
    rows = [("a", 0, math.nan), ("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, math.inf), ("a", 0, -math.inf), ("a", 1, -0.0), ("a", 0, 0.0)]
    r = R.pair_ranks(spark.createDataFrame(rows, SCHEMA), ["feature"]).first()
    assert (r["n0"], r["n1"]) == (4, 3) and r["u"] == sum((y > x) + (x == y) / 2 for x in (-math.inf, 0.0, 1.0) for y in (2.0, math.inf, 0.0))
    no_key = R.pair_ranks(spark.createDataFrame([("a", k % 2, float(k)) for k in range(6)], SCHEMA), [])
    assert no_key.first()["u"] == 6.0


def test_exact_p_equals_enumeration(spark):
    rng = random.Random(3)
    for _ in range(25):
        n0, n1 = rng.randrange(1, 5), rng.randrange(1, 6)
        values = sorted(float(rng.randrange(5)) for _ in range(n0 + n1))
        u_of = lambda own: sum((values[j] > values[i]) + (values[j] == values[i]) / 2 for j in own for i in range(len(values)) if i not in own)  # noqa: E731, B023
        every = [u_of(set(own)) for own in itertools.combinations(range(n0 + n1), n1)]
        sizes = [values.count(v) for v in sorted(set(values))]
        for u in set(every):
            low, high = sum(x <= u for x in every) / len(every), sum(x >= u for x in every) / len(every)
            assert R.exact_p(sizes, n0, n1, u) == pytest.approx(min(1.0, 2 * min(low, high)))
    rows = [("a", g, s) for g, s in ((0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 3.0), (1, 4.0))] + [("b", k % 2, float(k % 7)) for k in range(40)]
    p = {r["feature"]: r["exact_p"] for r in R.pair_ranks(spark.createDataFrame(rows, SCHEMA), ["feature"]).collect()}
    assert p["b"] is None and p["a"] == pytest.approx(R.exact_p([1, 3, 1, 1], 3, 3, 8.0))
