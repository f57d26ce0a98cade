import numpy as np
import pandas as pd
import pytest

from latticework.operators import graph as G

COMPLETE = [(i, j) for i in range(5) for j in range(i + 1, 5)]
STAR = [(0, j) for j in range(1, 6)]
PATH = [(i, i + 1) for i in range(4)]
CLIQUES = [(i, j) for b in (0, 4) for i in range(b, b + 4) for j in range(i + 1, b + 4)] + [(3, 4)]


@pytest.fixture(scope="module")
def known(spark):
    rows = [(g, i, j, 1.0) for g, e in (("complete", COMPLETE), ("star", STAR), ("path", PATH), ("cliques", CLIQUES)) for i, j in e]
    return spark.createDataFrame(rows, "g string, i long, j long, w double")


def by(df, *keys):
    return df.toPandas().set_index(list(keys))


def test_clustering(known):
    c = by(G.clustering(known, ["g"], G.nodes(known, ["g"])), "g", "node")["clustering"]
    assert (c["complete"] == 1).all() and (c["star"] == 0).all() and c["cliques"][3] == pytest.approx(0.5)


def test_paths(known):
    p = G.shortest_paths(known, ["g"], G.nodes(known, ["g"]))
    length, eff = by(G.path_length(p, ["g"]), "g")["path_length"], by(G.efficiency(p, ["g"], G.nodes(known, ["g"])), "g")["efficiency"]
    assert length["complete"] == 1 and eff["complete"] == 1 and length["path"] == 2.0 and length["star"] == pytest.approx(50 / 30)


def test_betweenness(known):
    b = by(G.betweenness(known, ["g"], G.nodes(known, ["g"])), "g", "node")["betweenness"]
    assert b["star"][0] == 5 * 4 and (b["complete"] == 0).all() and list(b["path"]) == [0, 6, 8, 6, 0]


def test_communities_and_modularity(spark, known):
    runs = G.louvain(known, ["g"], G.nodes(known, ["g"]), runs=3).filter("g = 'cliques'")
    pd.testing.assert_frame_equal(*(x.toPandas().sort_values(["run", "node"]).reset_index(drop=True) for x in (runs, G.louvain(known, ["g"], G.nodes(known, ["g"]), runs=3).filter("g = 'cliques'"))))
    first = runs.filter("run = 0")
    m = first.toPandas().sort_values("node")["module"].to_numpy()
    assert len(set(m[:4])) == 1 and len(set(m[4:])) == 1 and m[0] != m[7]
    q = G.modularity(known.filter("g = 'cliques'"), first.select("g", "node", "module"), ["g"]).first()["q"]
    assert q == pytest.approx(first.first()["q"])


def test_cut_keeps_negative_and_drops_missing(spark):
    conn = spark.createDataFrame([("a", 0, 1, -0.9), ("a", 0, 2, float("nan")), ("a", 1, 2, 0.5), ("a", 1, 3, 0.0)], "g string, i long, j long, w double")
    e = {(r["i"], r["j"]) for r in G.cut(G.ranked(conn, ["g"]), 1.0).collect()}
    assert e == {(0, 1), (1, 2)}


def test_relabel_puts_single_nodes_last(spark):
    m = spark.createDataFrame([("a", 0, 7), ("a", 1, 9), ("a", 2, 7), ("a", 3, 5), ("a", 4, 2), ("a", 5, 2)], "g string, node long, module long")
    got = by(G.relabel(m, ["g"]), "node")["module"]
    assert list(got.sort_index()) == [1, 3, 1, 3, 2, 2]


def test_nmi(spark):
    same = spark.createDataFrame([("x", "u", 3.0), ("y", "v", 2.0)], "a string, b string, n double")
    free = spark.createDataFrame([(a, b, 1.0) for a in "xy" for b in "uv"], "a string, b string, n double")
    assert G.partition_nmi(same, "a", "b").first()["nmi"] == pytest.approx(1) and G.partition_nmi(free, "a", "b").first()["nmi"] == pytest.approx(0, abs=1e-12)


def test_correlations_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([("a", r.tolist()) for r in x], "g string, v array<double>")
    got = by(G.correlations(df, "v", ["g"]), "i", "j")["w"]
    want = np.corrcoef(x.T)
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-8) for i in range(5) for j in range(i + 1, 5))


def test_channels_without_an_edge_count(spark, known):
    path = known.filter("g = 'path'")
    channels = G.nodes(path, ["g"]).unionByName(spark.createDataFrame([("path", 9), ("bare", 0), ("bare", 1)], "g string, node long"))
    keys = ["g"]
    assert by(G.degree(path, keys, channels), "g", "node")["degree"].to_dict() == {("path", k): [1, 2, 2, 2, 1][k] for k in range(5)} | {("path", 9): 0, ("bare", 0): 0, ("bare", 1): 0}
    p = G.shortest_paths(path, keys, channels)
    near = by(G.efficiency(p, keys, channels), "g")["efficiency"]
    assert near["path"] == pytest.approx(sum(2 / (b - a) for a in range(5) for b in range(a + 1, 5)) / 30) and near["bare"] == 0
    assert by(G.betweenness(path, keys, channels), "g", "node")["betweenness"]["path", 9] == 0 and G.clustering(path, keys, channels).count() == 8
    runs = G.louvain(path, keys, channels, runs=2)
    m = runs.filter("g = 'path' and run = 0").toPandas().set_index("node")["module"]
    assert len(m) == 6 and (m == m[9]).sum() == 1
    graph, nodal = G.mean_over_runs(path, runs, spark.createDataFrame([(i, j, 0.25) for i, j in PATH], "i long, j long, dist double"), keys)
    assert nodal.count() == 8 and nodal.filter("g = 'bare'").agg({"participation": "max"}).first()[0] == 0
    assert by(graph, "g")["modularity"]["path"] == pytest.approx(runs.filter("g = 'path'").groupBy("run").agg({"q": "max"}).toPandas().iloc[:, 1].mean())


def test_masks(spark):
    conn = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 0, 2, 0.7)], "g string, i long, j long, w double")
    net = spark.createDataFrame([("a", 0, 2)], "g string, i long, j long")
    assert [[r["w"] for r in G.mask_network(conn, net, ["g"], x).orderBy("j").collect()] for x in (True, False)] == [[0.0, 0.7], [0.5, 0.0]]
