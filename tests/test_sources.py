import numpy as np
import pandas as pd
import pytest

from latticework.operators import geometry as M
from latticework.sources import recordings as R
from latticework.streaming.windows import epoch_windows


def edf(path, signals, rate, seconds):
    n = len(signals)
    head = lambda fields: b"".join(str(v).ljust(w).encode() for v, w in fields)
    raw = head([("0", 8), ("p", 80), ("r", 80), ("01.01.26", 8), ("00.00.00", 8), (256 * (n + 1), 8), ("", 44), (seconds, 8), (1, 8), (n, 4)])
    for values, w in (([x for x, _ in signals], 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        raw += head([(v, w) for v in values])
    for s in range(seconds):
        for _, x in signals:
            raw += ((x[s * rate : (s + 1) * rate] + 100) / 200 * 65535 - 32768).round().astype("<i2").tobytes()
    path.write_bytes(raw)


def test_edf(spark, tmp_path):
    x = np.linspace(-50, 50, 40)
    edf(tmp_path / "s1.x.edf", [("EEG Fp1", x), ("ECG", -x), ("EEG Cz", -x)], 10, 4)
    got = R.read_recording(spark, str(tmp_path), "EDF").toPandas()
    assert set(got["channel"]) == {"Fp1", "Cz"} and set(got["subject"]) == {"s1"} and set(got["rate"]) == {10.0}
    assert np.allclose(got[got.channel == "Fp1"].sort_values("sample")["value"], x, atol=0.01)
    with pytest.raises(ValueError):
        R.read_recording(spark, str(tmp_path), "doc")


def test_brainvision(spark, tmp_path):
    x = np.arange(12, dtype="<i2").reshape(4, 3)
    (tmp_path / "s2.eeg").write_bytes(x.tobytes())
    (tmp_path / "s2.vhdr").write_text("Brain Vision Data Exchange Header File\n[Common Infos]\nDataFile=s2.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=3\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fp1,,0.5,uV\nCh2=ECG,,1,uV\nCh3=Cz,,2,uV\n")
    got = R.read_recording(spark, str(tmp_path), "BrainVision").toPandas().sort_values(["channel", "sample"])
    assert got["rate"].unique().tolist() == [250.0] and got["value"].tolist() == (2.0 * x[:, 2]).tolist() + (0.5 * x[:, 0]).tolist()


def test_electrodes(spark, tmp_path):
    (tmp_path / "e.elp").write_text("9\nEEG Fp1 -90 -72 1\nEEG\tCz 0 0 1\nFID Nz 90 0 1\n")
    e = R.read_electrodes(spark, str(tmp_path / "e.elp"))
    assert e.count() == 3 and e.filter("label = 'Fp1'").first()["angle1"] == -90
    ch = spark.createDataFrame([("Cz",), ("X",)], "channel string")
    assert {r["channel"]: r["radius"] for r in R.locate(ch, e).collect()} == {"Cz": 1.0, "X": None}


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    R.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "subject string, v int"), p)
    R.upsert(spark.createDataFrame([("b", 2)], "subject string, v int"), p)
    assert {(r["subject"], r["v"]) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 2)}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=k)).to_pydatetime()) for k in range(50)], "value int, ts timestamp").selectExpr("cast(value as double) value", "ts", "'c' as ch")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r["start"], r["n"], r["mean"]) for r in epoch_windows(df, "ts", "value", ["ch"]).collect()}
    q = epoch_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "value", ["ch"]).writeStream.format("memory").queryName("epochs").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["start"], r["n"], r["mean"]) for r in spark.table("epochs").collect()} == want


def test_arc_passes_its_three_points(spark):
    ends = spark.createDataFrame([(1.0, 0.0, 0.5, 0.0, 1.0, 0.5)], "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    p = M.arc_points(ends, 1.3, 101).orderBy("k").toPandas()
    xyz = p[["px", "py", "pz"]].to_numpy()
    assert np.allclose(xyz[0], [1, 0, 0.5]) and np.allclose(xyz[-1], [0, 1, 0.5])
    assert np.linalg.norm(xyz - np.array([0.65, 0.65, 0.65]), axis=1).min() < 0.02


def test_spline_keeps_a_constant(spark):
    ch = pd.DataFrame({"channel": list("abcd"), "x": [1.0, 0, 0, -1], "y": [0.0, 1, 0, 0], "z": [0.0, 0, 1, 0]})
    mesh = pd.DataFrame({"vertex": [0, 1], "x": [0.7, 0.0], "y": [0.7, 0.0], "z": [0.0, 1.0]})
    v = spark.createDataFrame([(1, c, 4.0) for c in "abcd"], "s int, channel string, value double")
    assert np.allclose(M.spherical_spline(v, ch, mesh, ["s"]).toPandas()["value"], 4.0)
