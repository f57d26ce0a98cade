"""Measures of all graphs in one call against the single operators, and the whole sweep."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.operators import graph as G
from latticework.operators import sweep as W
from latticework.plans import sweeps

SF = "/root/testdata/sf0.001"


def test_graph_measures_equal_the_single_operators(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(i), int(j), float(rng.random())) for g in range(4) for i in range(9) for j in range(i + 1, 9) if rng.random() < 0.15 + 0.2 * g]
    nodes = spark.createDataFrame([(g, n) for g in range(5) for n in range(9)], "g int, node long")  # the last graph has no edge
    edges = spark.createDataFrame(rows, "g int, i long, j long, w double")
    places = pd.DataFrame({"channel": range(9), "x": rng.normal(size=9), "y": rng.normal(size=9), "z": rng.normal(size=9)})
    got = {(r["g"], r["metric"], r["channel"]): r["value"] for r in W.graph_measures(edges, ["g"], nodes, places, runs=6).collect()}
    same = lambda metric, df, column: [got.pop((r["g"], metric, r["node"])) == pytest.approx(r[column]) for r in df.collect()]
    clustering = G.clustering(edges, ["g"], nodes)
    assert all(same("clustering", clustering, "clustering")) and all(same("degree", clustering, "degree"))
    runs = G.louvain(edges, ["g"], nodes, runs=6)
    xyz = places[["x", "y", "z"]].to_numpy()
    dist = spark.createDataFrame([(i, j, float(np.sqrt(((xyz[i] - xyz[j]) ** 2).sum()))) for i in range(9) for j in range(i + 1, 9)], "i long, j long, dist double")
    graph, nodal = G.mean_over_runs(edges, runs, dist, ["g"])
    assert all(same("participation coefficient", nodal, "participation")) and all(same("modules", nodal, "module"))
    paths = G.shortest_paths(edges, ["g"], nodes)
    whole = {"characteristic path length": (G.path_length(paths, ["g"]), "path_length"), "efficiency": (G.efficiency(paths, ["g"], nodes), "efficiency"), "modularity": (graph, "modularity"), "modular span": (graph, "span")}
    for metric, (df, column) in whole.items():
        for r in df.filter(F.col(column).isNotNull()).collect():
            assert all(got.pop((r["g"], metric, n)) == pytest.approx(r[column]) for n in range(9))
    assert not got


def test_medians_of_rows_with_a_zero_diagonal(spark):
    conn = spark.createDataFrame([("s", "a", "b", 0.9), ("s", "a", "c", 0.5), ("s", "b", "c", -0.2), ("t", "a", "b", float("nan"))], "subject string, i string, j string, w double")
    got = {(r["subject"], r["channel"]): r["value"] for r in W.median_rows(conn, ["subject"]).collect()}
    assert got == {("s", "a"): 0.5, ("s", "b"): 0.0, ("s", "c"): 0.0, ("t", "a"): 0.0, ("t", "b"): 0.0}


def test_the_sweep_holds_every_feature(spark):
    got = sweeps.feature_sweep(spark, SF).toPandas()
    assert set(got["feature"]) == {"power/mean", "median/median", "clustering/mean", "characteristic path length/mean", "modularity/mean", "participation coefficient/sd", "modular span/mean"}
    assert set(got["band"]) == {1, 2, 3} and ((got["auc"] >= 0.5) & (got["auc"] <= 1) & (got["p"] > 0) & (got["p"] <= 1)).all()
    assert got.groupby(["feature", "band", "g0", "g1"]).size().max() == 1 and (got[got["feature"] == "power/mean"]["t_idx"] == 0).all()
