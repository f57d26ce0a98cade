"""Places, filters in blocks, choices and readers of the small tables."""

import math

import numpy as np
import pytest

from latticework.operators import geometry as M
from latticework.operators import reference as R
from latticework.operators import signal as S
from latticework.operators import stats as T
from latticework.plans.covariates import auto_group
from latticework.sources.recordings import read_subjects

XYZ = "channel string, x double, y double, z double"


@pytest.mark.parametrize("nose, at", [("+X", (1.0, 2.0)), ("-x", (-1.0, -2.0)), ("+y", (2.0, -1.0)), ("-y", (-2.0, 1.0))])
def test_rotated(spark, nose, at):
    row = M.rotated(spark.createDataFrame([("a", 1.0, 2.0, 3.0)], XYZ), nose).first()
    assert (row.x, row.y, row.z) == pytest.approx((*at, 3.0))


def test_scalp_by_three_nearest(spark):
    rng = np.random.default_rng(3)
    ch, mesh = rng.normal(size=(6, 3)), rng.normal(size=(40, 3))
    channels = spark.createDataFrame([(f"c{k}", *map(float, p)) for k, p in enumerate(ch)], XYZ)
    vertices = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(mesh)], "vertex long, x double, y double, z double")
    got = {r.channel: (r.x, r.y, r.z) for r in M.on_scalp(channels, vertices).collect()}
    for k, p in enumerate(ch):
        near = np.argsort(((mesh - p) ** 2).sum(axis=1))[:3]
        assert got[f"c{k}"] == pytest.approx(tuple(1.06 * mesh[near].mean(axis=0)))


@pytest.mark.parametrize("to", [None, 100.0])
def test_filter_blocks_agree(spark, to):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(rng.normal(size=6000))], "channel string, sample long, value double")
    whole = S.filtered(df, 200.0, 30.0, 0.5, to).toPandas().sort_values("sample")
    cut = S.filtered(df, 200.0, 30.0, 0.5, to, block=1000).toPandas().sort_values("sample")
    assert whole["sample"].tolist() == cut["sample"].tolist() == list(range(6000 if to is None else 3000))
    assert np.allclose(whole["value"], cut["value"], atol=1e-9)


def test_line_noise_leaves_single_samples(spark):
    df = spark.createDataFrame([("a", 0, 5, 3.25)], "channel string, epoch int, sample int, value double")
    assert S.remove_line_noise(df, 24.0, 6.0).first()["value"] == 3.25


def test_choices(spark, tmp_path):
    assert [r.t_idx for r in R.nearest_density(R.thresholds(spark), 0.31).collect()] == [28]
    assert R.time_constant_hz([32, 2], 250.0) == pytest.approx([250 / 96, 250 / 6])
    assert (auto_group("allchan", 91), auto_group("frontal", 91)) == ("allchan_91", "frontal")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "g0 int, g1 int")
    assert sorted(map(tuple, T.chosen_pairs(pairs, [(0, 1), (1, 2)]).collect())) == [(0, 1), (1, 2)]
    (tmp_path / "s.csv").write_text("name,group\nx,1\ny,\n")
    assert [tuple(r) for r in read_subjects(spark, str(tmp_path / "s.csv"), "name string, grp int").collect()] == [("x", 1), ("y", None)]
    assert math.isclose(M.rotated(spark.createDataFrame([("a", 0.0, 1.0, 0.0)], XYZ), "?").first().x, -1.0)
