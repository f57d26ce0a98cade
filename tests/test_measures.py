import pytest

from latticework.operators import measures as M


def test_presets_and_groups(spark):
    rows = [("s", c, m, v) for m, vs in (("power", [0.1, 0.2, 0.3]), ("degree", [1.0, 2.0, 6.0]), ("other", [1.0, float("nan"), 3.0])) for c, v in zip("abc", vs, strict=True)]
    df = spark.createDataFrame(rows, "subject string, channel string, metric string, value double")
    groups = spark.createDataFrame([("g", "a"), ("g", "c")], "grp string, channel string")
    got = {r["feature"]: r["score"] for r in M.scores(df, [M.measure("Power"), M.measure("degree"), M.measure("other"), M.Measure("power", "max", 1.0, "g")], ["subject"], groups).collect()}
    assert got["power/mean"] == pytest.approx(20) and got["degree/sd"] == pytest.approx(7**0.5) and got["other/mean"] == 2 and got["power/max/g"] == 0.3
    with pytest.raises(ValueError):
        M.Measure("power", "sum")


def test_thresholds_must_be_there(spark):
    df = spark.createDataFrame([(0.1, 1), (0.125, 2)], "density double, v int")
    assert M.match_thresholds(df, [0.1]).count() == 1
    with pytest.raises(ValueError):
        M.match_thresholds(df, [0.3])
