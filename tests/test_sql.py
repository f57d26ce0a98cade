"""Table functions in SQL: keys of any kind, odd rows, clear errors."""

import numpy as np
import pytest

from latticework import sql
from latticework.operators import spectra as P


def test_graph_functions_keep_any_keys(spark):
    sql.register_functions(spark)
    rows = [("a", 1, 0, 1, 0.9), ("a", 1, 0, 2, -0.8), ("a", 1, 1, 2, 0.7), ("a", 1, 0, 3, float("nan")), ("a", 1, 1, 3, None), ("a", 1, 2, 3, 0.1), ("b", None, 0, 1, 0.0)]
    spark.createDataFrame(rows, "subject string, band int, i int, j int, w double").createOrReplaceTempView("pairs")
    got = {(r["subject"], r["band"], r["node"]): (r["degree"], r["clustering"]) for r in spark.sql("SELECT * FROM graph_nodes(TABLE(pairs) PARTITION BY (subject, band), 0.5D)").collect()}
    assert got == {("a", 1, 0): (2, 1.0), ("a", 1, 1): (2, 1.0), ("a", 1, 2): (2, 1.0), ("a", 1, 3): (0, 0.0), ("b", None, 0): (0, 0.0), ("b", None, 1): (0, 0.0)}
    got = {r["subject"]: (r["edges"], r["path_length"], r["efficiency"]) for r in spark.sql("SELECT * FROM graph_summary(TABLE(pairs) PARTITION BY (subject, band), 0.5D)").collect()}
    assert got["a"] == pytest.approx((3, 1.0, 0.5)) and got["b"] == (0, None, 0.0)


def test_channels_may_come_late(spark):
    """Rows whose channels differ add up as blocks do."""
    sql.register_functions(spark)
    rng = np.random.default_rng(1)
    rows, long = [], []
    for e in range(8):
        waves = {c: {t: float(rng.normal()) for t in range(16)} for c in ("z", "b", "m")[: 1 + e % 3]}
        rows.append(("s", waves))
        long += [("s", c, e, t, v) for c, w in waves.items() for t, v in w.items()]
    spark.createDataFrame(rows, "subject string, waves map<string, map<int, double>>").createOrReplaceTempView("epochs")
    got = {tuple(r)[:4]: r["w"] for r in spark.sql("SELECT * FROM phase_connectivity(TABLE(epochs) PARTITION BY (subject), 16.0D, 16, 2.0D, 1.0D, 7.0D)").collect()}
    df = spark.createDataFrame(long, "subject string, channel string, epoch int, sample int, value double")
    names = ["b", "m", "z"]
    want = {tuple(r)[:4]: r["w"] for r in P.block_wpli(P.cross_blocks(df, names, 16.0, 16, 2.0, 1.0, 7.0), names).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in got)


def test_errors_say_what_is_missing(spark):
    sql.register_functions(spark)
    spark.createDataFrame([(1, 2)], "i int, j int").createOrReplaceTempView("few")
    with pytest.raises(Exception, match="needs a column w"):
        spark.sql("SELECT * FROM graph_nodes(TABLE(few) PARTITION BY (i), 0.5D)")
    spark.createDataFrame([(1, "x", 0.5)], "i int, j string, w double").createOrReplaceTempView("named")
    with pytest.raises(Exception, match="j must be"):
        spark.sql("SELECT * FROM graph_nodes(TABLE(named) PARTITION BY (i), 0.5D)")


def test_views(spark):
    sql.register(spark, "/root/testdata/sf0.001")
    assert spark.sql("SELECT count(*) FROM recordings JOIN samples USING (channel)").count() == 1
    assert {"connectivity", "events", "labels", "recordings", "samples"} <= {t.name for t in spark.catalog.listTables()}
