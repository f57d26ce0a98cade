import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import signal as S
from latticework.operators.components import independent_components


def test_tapers_concentration():
    t = S.tapers(250, 3.0)
    assert t.shape == (5, 250) and np.allclose(t @ t.T, np.eye(5), atol=1e-8)


def test_lag_gives_phase_connectivity_and_mixing_none(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(30):
        phase = rng.uniform(0, 2 * math.pi)
        for t in range(50):
            base = 2 * math.pi * 5 * t / 50
            a = math.cos(base + phase)
            rows += [("a", e, t, a), ("b", e, t, math.cos(base + phase - 1.0) + 0.1 * rng.normal()), ("c", e, t, 0.5 * a + 0.3 * rng.normal())]
    f = S.fourier(spark.createDataFrame(rows, "channel string, epoch int, sample int, value double"), 50, 6)
    w = {(r["ch_i"], r["ch_j"]): r["w"] for r in S.debiased_wpli(S.cross_spectrum(f)).filter("bin = 5").collect()}
    assert w["a", "b"] > 0.95 and abs(w["a", "c"]) < 0.3


def test_tone_peaks_in_its_band(spark):
    rows = [("a", e, t, math.sin(2 * math.pi * 10 * t / 100)) for e in range(2) for t in range(200)]
    p = S.multitaper(spark.createDataFrame(rows, "channel string, epoch int, sample int, value double"), 100.0, 200, smoothing=1.0)
    assert p.orderBy(F.desc("power")).first()["freq"] == pytest.approx(10, abs=1.0)


def test_filter_order_and_refusal(spark):
    rows = [("a", t, 5.0 + math.sin(2 * math.pi * 10 * t / 500) + math.sin(2 * math.pi * 120 * t / 500)) for t in range(2000)]
    df = spark.createDataFrame(rows, "channel string, sample long, value double")
    out = S.filtered(df, 500.0, 45.0, 0.5, 250.0).toPandas().sort_values("sample")
    assert len(out) == 1000
    x = out["value"].to_numpy()[250:750]
    power = np.abs(np.fft.rfft(x)) ** 2
    assert power.argmax() == 20 and abs(x.mean()) < 0.1
    with pytest.raises(ValueError):
        S.filtered(df, 200.0, resample_to=250.0)


def test_line_noise(spark):
    rows = [("a", 0, t, math.sin(2 * math.pi * 50 * t / 250 + 0.3) + 0.01 * t) for t in range(250)]
    out = S.remove_line_noise(spark.createDataFrame(rows, "channel string, epoch int, sample int, value double"), 250.0).toPandas().sort_values("sample")
    assert np.abs(np.fft.rfft(out["value"].to_numpy()))[50] < 1e-6


def test_quietest_keeps_all_when_few(spark):
    df = spark.createDataFrame([("a", e, t, float(e * t)) for e in range(3) for t in range(4)], "channel string, epoch int, sample int, value double")
    assert [r["epoch"] for r in S.quietest(df, 2).orderBy("rank").collect()] == [0, 1] and S.quietest(df, 9).count() == 3


def test_symbols_and_information(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(4):
        x, y = rng.normal(size=200).cumsum(), rng.normal(size=200).cumsum()
        rows += [(c, e, t, float(v)) for c, s in (("a", x), ("b", x), ("c", y)) for t, v in enumerate(s)]
    w = {(r["ch_i"], r["ch_j"]): r["w"] for r in S.weighted_symbolic_information(S.symbols(spark.createDataFrame(rows, "channel string, epoch int, sample int, value double"), 2)).collect()}
    assert w["a", "b"] == 0 and 0 <= w["a", "c"] < 0.05


def test_laplacian_sharpens_a_focus(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(20, 3))
    xyz /= np.linalg.norm(xyz, axis=1, keepdims=True)
    ch = pd.DataFrame({"channel": [f"c{k}" for k in range(20)], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    rows = [(0, f"c{k}", t, float(np.exp(-((xyz[k] - xyz[3]) ** 2).sum()) + 5.0)) for k in range(20) for t in range(2)]
    out = S.surface_laplacian(spark.createDataFrame(rows, "epoch int, channel string, sample int, value double"), ch).toPandas()
    one = out[out["sample"] == 0].set_index("channel")["value"]
    assert len(out) == 40 and one.idxmax() == "c3"


def test_components_leave_out_the_spikes(spark):
    rng = np.random.default_rng(0)
    n = 800
    calm, spikes = np.sin(np.arange(n) * 0.2), (rng.random(n) < 0.02) * 20.0
    mix = np.array([[1.0, 0.6], [0.5, 1.0]]) @ np.stack([calm, spikes])
    rows = [("s", f"c{k}", t, float(mix[k, t])) for k in range(2) for t in range(n)]
    df = spark.createDataFrame(rows, "subject string, channel string, sample int, value double")
    same = independent_components(df).toPandas().sort_values(["channel", "sample"])["value"].to_numpy()
    assert np.allclose(same, mix.ravel(), atol=1e-6)
    clean = independent_components(df, reject=[0]).toPandas().sort_values(["channel", "sample"])["value"].to_numpy().reshape(2, n)
    assert abs(np.corrcoef(clean[0], calm)[0, 1]) > 0.97
