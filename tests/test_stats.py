import itertools

import pytest
from pyspark.sql import functions as F

from latticework.operators import classify as C
from latticework.operators import stats as T


def scores(spark, rows):
    return spark.createDataFrame(rows, "feature int, grp int, score double")


def test_rank_statistics(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 6.0]
    df = scores(spark, [(0, 0, x) for x in a] + [(0, 1, x) for x in b])
    r = T.rank_statistics(T.pair_counts(T.value_counts(df, ["feature"]), T.group_pairs(df), ["feature"]), ["feature"]).first()
    u = sum((y > x) + 0.5 * (y == x) for x, y in itertools.product(a, b))
    assert r["u"] == u and r["auc"] == max(u, 12 - u) / 12 and r["u_min"] == min(u, 12 - u)


def test_youden_is_strict(spark):
    df = scores(spark, [(0, 0, 1.0), (0, 0, 2.0), (0, 1, 3.0), (0, 1, 4.0)])
    r = T.contingency(T.youden(T.pair_counts(T.value_counts(df, ["feature"]), T.group_pairs(df), ["feature"]), ["feature"])).first()
    assert r["threshold"] == 3.0 and r["j"] == 1.0 and (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 0, 2)


def test_discovery(spark):
    p = [0.001, 0.01, 0.03, 0.2, 0.5]
    got = T.discovery_threshold(spark.createDataFrame([(x,) for x in p], "p double"), "p")
    assert got.first()["fdr"] == 0.03


def test_permutations_repeat_and_bound(spark):
    df = spark.createDataFrame([(u, u % 2, f, float(u % 2 * 5 * (f == 0) + (u * 7 + f) % 3)) for u in range(20) for f in range(3)], "unit int, grp int, feature int, score double")
    one = T.max_statistic(T.permuted_differences(df, "score", ["feature"], 50), ["feature"]).toPandas().sort_values("feature")
    two = T.max_statistic(T.permuted_differences(df, "score", ["feature"], 50), ["feature"]).toPandas().sort_values("feature")
    assert one["p"].tolist() == two["p"].tolist() and one["p"].iloc[0] <= 2 / 51 and one["p"].iloc[1:].min() > 0.05
    with pytest.raises(ValueError):
        T.permuted_differences(df.filter("grp = 0"), "score", ["feature"], 5)


def test_exact_p():
    assert T.exact_rank_sum_p(3, 3, 0) == pytest.approx(0.1) and T.exact_rank_sum_p(3, 3, 4.5) == 1.0


def test_votes_table(spark):
    want = {(-1, -1): 1, (-1, 0): 0, (-1, 1): 0, (0, -1): 1, (0, 0): 1, (0, 1): 2, (1, -1): 1, (1, 0): 1, (1, 1): 1}
    df = spark.createDataFrame([(a, b) for a, b in want], "s1 int, s2 int")
    got = {(r["s1"], r["s2"]): r["cls"] for r in C.decode_votes(df).collect()}
    assert got == want


def test_bayes_sums_to_one(spark):
    df = spark.createDataFrame([(k, c, p) for k in range(3) for c, p in (("a", 0.2), ("b", 0.8))], "k int, cls string, p double")
    out = C.bayes(df.withColumn("s", F.lit(1)), ["s"], "k").toPandas()
    assert out.groupby("k")["posterior"].sum().tolist() == pytest.approx([1, 1, 1])
    assert out[(out.k == 2) & (out.cls == "a")]["posterior"].iloc[0] == pytest.approx(0.2**3 / (0.2**3 + 0.8**3))


def test_train(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([float(i % 2), i / 10]), float(i % 2)) for i in range(20)], ["features", "label"])
    for name in ("tree", "svm-linear", "nbayes", "nn"):
        assert T and C.train(df, name).transform(df).filter("prediction = label").count() >= 18
    with pytest.raises(ValueError):
        C.train(df, "other")


def test_nearest_neighbours(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([float(i % 2), i / 100]), float(i % 2)) for i in range(20)], ["features", "label"])
    assert C.nearest_neighbours(df, df, 3).filter("prediction = label").count() == 20
    with pytest.raises(ValueError):
        C.nearest_neighbours(df, df, 3, most=10)
