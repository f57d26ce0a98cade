"""Recordings as a data source: files written here by the formats' descriptions, read back in slabs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.sources import matlab, slabs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, value):
    """A MAT element of a number matrix, text, structure rows or cell."""
    if isinstance(value, str):
        flags, shape, body = 4, (1, len(value)), element(17, value.encode("utf-16-le")) if any(ord(c) > 127 for c in value) else element(16, value.encode())
    elif isinstance(value, list):
        names = list(value[0]) if value else []
        packed = b"".join(n.encode().ljust(32, b"\0") for n in names)
        flags, shape, body = 2, (1, len(value)), struct.pack("<HHi", 5, 4, 32) + element(1, packed) + b"".join(array("", r[n]) for r in value for n in names)
    else:
        value = np.atleast_2d(np.asarray(value))
        kind, flags = {"float64": (9, 6), "float32": (7, 7), "int32": (5, 12)}[value.dtype.name]
        shape, body = value.shape, element(kind, value.tobytes(order="F"))
    head = element(6, struct.pack("<II", flags, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
    return element(14, head + body)


def mat(variables, packed=False):
    parts = [array(n, v) for n, v in variables.items()]
    if packed:
        parts = [struct.pack("<II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    return b"MATLAB 5.0 MAT-file".ljust(124) + b"\0\1IM" + b"".join(parts)


@pytest.fixture(scope="module")
def recorded(spark):
    """The given events as channels by epochs of 24 samples."""
    rows = spark.read.parquet(EVENTS).groupBy(F.col("event_type").alias("channel"), (F.dayofyear("ts") - 1).alias("epoch"), F.hour("ts").alias("sample")).agg(F.round(F.avg("value"), 3).alias("value")).toPandas()
    names = sorted(rows["channel"].unique())
    x = np.zeros((len(names), int(rows["epoch"].max()) + 1, 24), np.float32)
    for r in rows.itertuples():
        x[names.index(r.channel), r.epoch, r.sample] = r.value
    return names, x


def expected(subject, names, x, epochs=True):
    flat = x if epochs else x.reshape(len(names), 1, -1)
    return {(subject, c, e, t): float(flat[k, e, t]) for k, c in enumerate(names) for e in range(flat.shape[1]) for t in range(flat.shape[2])}


def rows_of(df):
    rows = df.collect()
    out = {(r["subject"], r["channel"], r["epoch"], r["sample"]): r["value"] for r in rows}
    assert len(out) == len(rows)
    return out


def fields(names, x, data):
    return {"nbchan": float(len(names)), "pnts": 24.0, "trials": float(x.shape[1]), "srate": 24.0, "setname": "é", "chanlocs": [{"labels": n, "X": 1.5} for n in names], "data": data}


@pytest.mark.parametrize("how", ["beside", "inside", "compressed", "variables"])
def test_set(spark, tmp_path, recorded, how):
    names, x = recorded
    flat = x.transpose(0, 2, 1).reshape(len(names), -1, order="F")  # channels by samples, epochs one after another
    assert (flat[:, 24:48] == x[:, 1]).all()
    own = fields(names, x, "s1.fdt" if how in ("beside", "variables") else flat)
    (tmp_path / "s1.set").write_bytes(mat(own if how == "variables" else {"EEG": [own]}, how == "compressed"))
    (tmp_path / "s1.fdt").write_bytes(flat.tobytes(order="F"))
    df = slabs.read_slabs(spark, str(tmp_path / "s1.set"), 5 * 40)
    assert rows_of(df) == expected("s1", names, x)
    assert df.rdd.getNumPartitions() == (1 if how == "compressed" else -(-x.shape[1] * 24 // 40))
    assert df.first()["rate"] == 24.0


def test_headers_open_no_data(spark, tmp_path, recorded):
    names, x = recorded
    for s in ("a", "b"):
        (tmp_path / f"{s}.set").write_bytes(mat({"EEG": [fields(names, x, f"{s}.fdt")]}))  # and no data file
    got = slabs.read_slabs(spark, str(tmp_path), headers=True).collect()
    assert {(r["subject"], r["channel"]) for r in got} == {(s, n) for s in "ab" for n in names} and all((r["epochs"], r["samples"], r["rate"]) == (x.shape[1], 24, 24.0) for r in got)
    with pytest.raises(Exception, match="fdt"):
        slabs.read_slabs(spark, str(tmp_path)).count()


def test_conditions_reach_the_files(spark, tmp_path, recorded):
    names, x = recorded
    flat = x.transpose(0, 2, 1).reshape(len(names), -1, order="F")
    for s in ("a", "b"):
        (tmp_path / f"{s}.set").write_bytes(mat({"EEG": [fields(names, x, f"{s}.fdt")]}))
    (tmp_path / "b.fdt").write_bytes(flat.tobytes(order="F"))  # a's data are missing, so reading them would fail
    df = slabs.read_slabs(spark, str(tmp_path / "*.set"))
    got = rows_of(df.filter(f"subject = 'b' and channel in ('{names[0]}', '{names[2]}') and sample < 3"))
    assert got == {k: v for k, v in expected("b", names, x).items() if k[1] in (names[0], names[2]) and k[3] < 3}
    assert df.filter("subject = 'c'").count() == 0 and df.filter("subject = 'b' and channel = 'zz'").count() == 0


@pytest.mark.parametrize("version, kind", [(2, ">i2"), (4, ">f4"), (6, ">f8")])
def test_raw(spark, tmp_path, recorded, version, kind):
    names, x = recorded
    flat = np.round(x.reshape(len(names), -1)) if version == 2 else x.reshape(len(names), -1)
    n = flat.shape[1]
    head = struct.pack(">i6hi5hih", version, 2020, 1, 1, 0, 0, 0, 0, 250, len(names), 1, 0, 0, n, 2) + b"DIN1DIN2"
    (tmp_path / "r.raw").write_bytes(head + np.vstack([flat, np.ones((2, n))]).T.astype(kind).tobytes())
    got = rows_of(slabs.read_slabs(spark, str(tmp_path / "r.raw"), 7 * 100))
    want = expected("r", [f"E{k + 1}" for k in range(len(names))], flat.astype(np.float64).reshape(len(names), 1, -1))
    assert got == want
    (tmp_path / "s.raw").write_bytes(struct.pack(">i", 3) + head[4:])
    with pytest.raises(Exception, match="version 3"):
        slabs.read_slabs(spark, str(tmp_path / "s.raw")).count()


def test_edf_in_slabs_equals_the_whole(spark, tmp_path):
    from latticework.sources.recordings import read_edf

    labels, per, records = ["EEG Fz", "ECG", "EEG Cz"], 8, 13
    text = lambda v, w: str(v).ljust(w).encode()
    data = np.random.default_rng(1).integers(-3000, 3000, (records, 3, per)).astype("<i2")
    head = b"".join([text(0, 8), text("p", 80), text("r", 80), text("01.01.20", 8), text("00.00.00", 8), text(256 * 4, 8), text("", 44), text(records, 8), text(1, 8), text(3, 4)])
    columns = [labels, ["x"] * 3, ["uV"] * 3, [-200, -1, -100], [200, 1, 100], [-32768] * 3, [32767] * 3, [""] * 3, [per] * 3, [""] * 3]
    head += b"".join(text(v, w) for own, w in zip(columns, (16, 80, 8, 8, 8, 8, 8, 80, 8, 32), strict=True) for v in own)
    (tmp_path / "e.edf").write_bytes(head + data.tobytes() + b"\1\2\3")
    got = {k: v for k, v in rows_of(slabs.read_slabs(spark, str(tmp_path / "e.edf"), 3 * per * 2)).items()}
    want = {(r["subject"], r["channel"], 0, r["sample"]): r["value"] for r in read_edf(spark, str(tmp_path / "e.edf")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_wrong_files(spark, tmp_path):
    (tmp_path / "x.set").write_bytes(b"not a recording")
    with pytest.raises(Exception, match="MAT-file"):
        slabs.read_slabs(spark, str(tmp_path / "x.set")).count()
    with pytest.raises(Exception, match="unsupported"):
        (tmp_path / "x.txt").write_bytes(b"")
        slabs.read_slabs(spark, str(tmp_path / "x.txt")).count()
    assert isinstance(matlab.elements(mat({"a": 2.5}))["a"], matlab.Stored)
