import numpy as np
import pandas as pd
import pytest

from latticework.operators.conditions import network_statistic, one_sided, permuted_wpli

EPOCHS = 60


def wpli(im):
    s, a, q = im.sum(), np.abs(im).sum(), (im**2).sum()
    return (s * s - q) / (a * a - q)


@pytest.fixture(scope="module")
def recording():
    rng = np.random.default_rng(3)
    rows = []
    for e in range(EPOCHS):
        for b in (8, 9, 10):
            for i, j in ((0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)):
                rows.append((e, b, f"E{i}", f"E{j}", rng.normal() + (3.0 if e < EPOCHS // 2 and j < 3 else 0.0)))
    return pd.DataFrame(rows, columns=["epoch", "bin", "ch_i", "ch_j", "im"])


def differences(p, first):
    """Each side's dwPLI of every pair at the side's own peak, written out."""
    sides = []
    for side in (first, set(p["epoch"]) - first):
        w = p[p["epoch"].isin(side)].groupby(["bin", "ch_i", "ch_j"])["im"].apply(lambda x: wpli(x.to_numpy()))
        sides.append(w.loc[w.groupby("bin").mean().idxmax()])
    return (sides[0] - sides[1]).sort_index()


def epochs(spark, p, first):
    return spark.createDataFrame([(e, int(e not in first)) for e in sorted(set(p["epoch"]))], "epoch long, condition int")


def test_every_permutation_by_hand(spark, recording):
    first = set(range(EPOCHS // 2))
    got = permuted_wpli(spark.createDataFrame(recording), epochs(spark, recording, first), perms=5).toPandas()
    order = np.array(sorted(first) + sorted(set(range(EPOCHS)) - first))
    for k in range(6):
        bits = np.arange(EPOCHS) < EPOCHS // 2
        own = set(order[bits if k == 0 else np.random.default_rng([1, k]).permutation(bits)].tolist())
        mine = got[got["perm"] == k].set_index(["ch_i", "ch_j"])["diff"].sort_index()
        assert np.allclose(mine, differences(recording, own), atol=1e-9) and len(mine) == 6


def test_linked_channels_make_one_component(spark, recording):
    d = permuted_wpli(spark.createDataFrame(recording), epochs(spark, recording, set(range(EPOCHS // 2)))).toPandas()
    got = spark.createDataFrame(d)
    p = one_sided(got).toPandas().set_index(["ch_i", "ch_j"])
    peaks = d.groupby("perm")["diff"].max()
    assert all(abs(r["p"] - (peaks >= r["diff"]).mean()) < 1e-12 for _, r in p.iterrows())
    assert (p[p.index.get_level_values("ch_j") != "E3"]["p"] < 0.05).all()
    n = network_statistic(got).toPandas()
    seen = p[(p["diff"] > 0) & (p["p"] < 0.05)]["diff"]
    above = (p["diff"] - seen.min()).clip(lower=0)
    assert len(n) == 1 and n["nodes"][0] == 3 and abs(n["intensity"][0] - above.sum()) < 1e-9 and n["p"][0] < 0.05


def test_unequal_conditions_are_refused(spark, recording):
    with pytest.raises(Exception, match="same number of epochs"):
        permuted_wpli(spark.createDataFrame(recording), epochs(spark, recording, set(range(7))), perms=2).count()
