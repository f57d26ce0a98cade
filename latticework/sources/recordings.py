"""Readers: EDF and BrainVision recordings, electrode tables and subject lists; upserting writes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The widths of an EDF file's header fields, then of those that every signal has.
EDF_HEAD = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("reserved", 44), ("records", 8), ("seconds", 8), ("signals", 4))
EDF_SIGNAL = (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
FORMATS = ("edf", "brainvision")


def parse_edf(raw: bytes) -> tuple[dict, list[dict], list[np.ndarray]]:
    """Header, signals' headers and each signal's physical values; an incomplete last record is left out."""
    head, at = {}, 0
    for name, width in EDF_HEAD:
        head[name], at = raw[at : at + width].decode("latin1").strip(), at + width
    n = int(head["signals"])
    signals: list[dict] = [{} for _ in range(n)]
    for name, width in EDF_SIGNAL:
        for s in signals:
            s[name], at = raw[at : at + width].decode("latin1").strip(), at + width
    each = [int(s["samples"]) for s in signals]
    data = np.frombuffer(raw, "<i2", offset=int(head["bytes"]), count=(len(raw) - int(head["bytes"])) // 2 // max(1, sum(each)) * sum(each)).reshape(-1, sum(each))
    values, begin = [], 0
    for s, k in zip(signals, each, strict=True):
        lo, hi, a, b = (float(s[x]) for x in ("dmin", "dmax", "pmin", "pmax"))
        values.append((data[:, begin : begin + k].ravel() - lo) * ((b - a) / (hi - lo)) + a)
        begin += k
    return head, signals, values


def read_edf(spark: SparkSession, path: str, prefix: str = "EEG ") -> DataFrame:
    """subject (the file's stem), channel, rate, sample, value of the signals whose labels start with the prefix, which is taken off. One task reads a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, raw in zip(files["path"], files["content"], strict=True):
                head, signals, values = parse_edf(raw)
                for s, v in zip(signals, values, strict=True):
                    if s["label"].startswith(prefix):
                        yield pd.DataFrame({"subject": name.rsplit("/", 1)[-1].split(".", 1)[0], "channel": s["label"][len(prefix) :], "rate": int(s["samples"]) / float(head["seconds"]), "sample": np.arange(len(v)), "value": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "subject string, channel string, rate double, sample long, value double")


def parse_vision_header(text: str) -> dict:
    """Name of the data file, rate, layout, number format and the channels' (label, resolution) of a BrainVision header."""
    sections: dict[str, dict[str, str]] = {}
    own: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            own = sections.setdefault(line[1:-1].lower(), {})
        elif "=" in line and not line.startswith(";"):
            k, v = line.split("=", 1)
            own[k.strip().lower()] = v.strip()
    common = sections["common infos"]
    channels = []
    for k in range(1, int(common["numberofchannels"]) + 1):
        label, _, resolution, *_ = [*sections["channel infos"][f"ch{k}"].split(","), "", "", ""]
        channels.append((label.replace("\\1", ","), float(resolution or 1)))
    kind = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[sections["binary infos"]["binaryformat"].upper()]
    return {"data": common["datafile"], "rate": 1e6 / float(common["samplinginterval"]), "vectorized": common.get("dataorientation", "MULTIPLEXED").upper() == "VECTORIZED", "kind": kind, "channels": channels}


def read_brainvision(spark: SparkSession, path: str, drop: tuple[str, ...] = ("ECG",)) -> DataFrame:
    """subject, channel, rate, sample, value of the header files (.vhdr) in a folder and their data files, less the dropped labels.

    Headers, small texts, meet their data files by name; one task reads a recording at a time.
    """
    kinds = spark.read.format("binaryFile").load(path).select("path", "content")
    heads = kinds.filter(F.col("path").endswith(".vhdr")).select("path", F.col("content").cast("string").alias("head"))
    heads = heads.withColumn("data", F.concat(F.regexp_extract("path", r"^(.*/)", 1), F.regexp_extract("head", r"(?im)^DataFile=\s*(.+?)\s*$", 1)))
    both = heads.join(kinds.select(F.col("path").alias("data"), "content"), "data").select("path", "head", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, head, raw in files[["path", "head", "content"]].itertuples(index=False):
                h = parse_vision_header(head)
                x = np.frombuffer(raw, h["kind"])
                n = len(h["channels"])
                x = x[: len(x) // n * n]
                x = x.reshape(n, -1) if h["vectorized"] else x.reshape(-1, n).T
                for (label, resolution), v in zip(h["channels"], x, strict=True):
                    if label not in drop:
                        yield pd.DataFrame({"subject": name.rsplit("/", 1)[-1].split(".", 1)[0], "channel": label, "rate": h["rate"], "sample": np.arange(len(v)), "value": v * resolution})

    return both.mapInPandas(run, "subject string, channel string, rate double, sample long, value double")


def read_recording(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind.lower() not in FORMATS:
        raise ValueError(f"unsupported recording type {kind}")
    return {"edf": read_edf, "brainvision": read_brainvision}[kind.lower()](spark, path)


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """type, label, angle1, angle2, radius from a white-space separated text; lines of other shapes, such as a leading count, are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 5)
    return rows.select(F.col("p")[0].alias("type"), F.col("p")[1].alias("label"), *[F.col("p")[k].cast("double").alias(n) for k, n in ((2, "angle1"), (3, "angle2"), (4, "radius"))])


def locate(df: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Adds the standard position of each channel's label; electrode tables are a few hundred rows."""
    return df.join(F.broadcast(electrodes.select(F.col("label").alias("channel"), "angle1", "angle2", "radius")), "channel", "left")


def read_subjects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def upsert(df: DataFrame, path: str, by: str = "subject") -> None:
    """Replaces the partitions that df has rows of and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def save_dataset(df: DataFrame, path: str, stage: str, reference: str = "REFCZ", by: str = "subject") -> str:
    """Writes a stage of the processing ("orig", "epochs") beside the others, with the reference channel's name on each row; subjects that df has no rows of stay. Returns where."""
    where = f"{path.rstrip('/')}_{stage}"
    upsert(df.withColumn("reference", F.lit(reference)), where, by)
    return where
