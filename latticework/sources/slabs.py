"""Recordings as a Spark data source: partitions are slabs of time, so a file of any length is read by many tasks.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("slab", 100_000).load("/data/*.set")
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from latticework.sources import matlab
from latticework.sources.recordings import EDF_HEAD, EDF_SIGNAL

SAMPLES = "subject string, channel string, rate double, epoch int, sample long, value double"
HEADERS = "subject string, path string, channel string, rate double, epochs int, samples long"


def opened(path: str) -> pa.NativeFile:
    """The file for reading at any place; local paths and the stores that pyarrow knows by their scheme."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def listed(path: str) -> list[str]:
    """Files that a path with * and ? in its last part, a folder or a file names, in order."""
    head = path.split("://", 1)[0] + "://" if "://" in path else ""
    store, inner = fs.FileSystem.from_uri(path.rsplit("/", 1)[0]) if head else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if head:
        inner = f"{inner}/{path.rsplit('/', 1)[1]}"
    if not set("*?[") & set(inner):
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [path]
        inner = inner.rstrip("/") + "/*"
    folder, pattern = inner.rsplit("/", 1)
    found = store.get_file_info(fs.FileSelector(folder or "/"))
    keep = [f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.extension.lower() in READERS]
    if head and head != "file://":
        host = path[len(head) :].split("/", 1)[0]
        return sorted(f"{head}{host}{p}" if p.startswith("/") else f"{head}{p}" for p in keep)
    return sorted(head + p for p in keep)


@dataclass(frozen=True)
class Header:
    """What a file's first bytes tell. A record is `wide` numbers of one kind; of channel k, `rows[k]` are the places in it."""

    path: str
    subject: str
    rate: float
    channels: tuple[str, ...]
    rows: tuple[tuple[int, ...], ...]
    samples: int
    epochs: int
    data: str
    offset: int
    kind: str
    wide: int
    gain: tuple[float, ...]
    shift: tuple[float, ...]
    split: bool = True

    @property
    def records(self) -> int:
        return self.samples * self.epochs // len(self.rows[0]) if self.rows else 0


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def set_header(path: str) -> Header:
    """An EEGLAB set: its structure, whole or as single variables; data lie in a file beside it, or in it. Data that are compressed with their structure can't be split."""
    with opened(path) as f:
        raw = f.read()
    found = matlab.elements(raw)
    eeg = found["EEG"][0] if isinstance(found.get("EEG"), list) else found
    n, samples, epochs = (int(eeg[k].number()) for k in ("nbchan", "pnts", "trials"))
    labels = tuple(str(c.get("labels") or f"{k + 1}") for k, c in enumerate(eeg["chanlocs"])) if isinstance(eeg.get("chanlocs"), list) else ()
    labels = labels if len(labels) == n else tuple(str(k + 1) for k in range(n))
    data = eeg["data"]
    if isinstance(data, matlab.Stored):
        outside, at, kind, split = path, data.at, data.kind, data.raw is raw
    else:
        outside, at, kind, split = f"{path.rsplit('/', 1)[0]}/{data}" if "/" in path else data, 0, "<f4", True
    return Header(path, stem(path), float(eeg["srate"].number()), labels, tuple((k,) for k in range(n)), samples, max(1, epochs), outside, at, kind, n, (1.0,) * n, (0.0,) * n, split)


def raw_header(path: str) -> Header:
    """An unsegmented EGI simple binary file: big-endian, samples of all channels and events in turn."""
    with opened(path) as f:
        head = f.read(36)
        version, *_, rate, n, _, bits, span, samples, events = struct.unpack(">i6hi5hih", head[:36])
    kinds = {2: ">i2", 4: ">f4", 6: ">f8"}
    if version not in kinds:
        raise ValueError(f"{path}: version {version}; only unsegmented files (2, 4, 6) are read")
    gain = span / 2**bits if version == 2 and bits and span else 1.0
    return Header(path, stem(path), float(rate), tuple(f"E{k + 1}" for k in range(n)), tuple((k,) for k in range(n)), samples, 1, path, 36 + 4 * events, kinds[version], n + events, (gain,) * n, (0.0,) * n)


def edf_header(path: str) -> Header:
    """An EDF file's signals of the commonest rate whose labels start with EEG; records in turn."""
    with opened(path) as f:
        size, raw = f.size(), f.read(256)
        head, at = {}, 0
        for name, width in EDF_HEAD:
            head[name], at = raw[at : at + width].decode("latin1").strip(), at + width
        n = int(head["signals"])
        raw, at = f.read(256 * n), 0
    signals: list[dict] = [{} for _ in range(n)]
    for name, width in EDF_SIGNAL:
        for s in signals:
            s[name], at = raw[at : at + width].decode("latin1").strip(), at + width
    each = [int(s["samples"]) for s in signals]
    starts = np.concatenate([[0], np.cumsum(each)])
    own = [k for k in range(n) if signals[k]["label"].startswith("EEG ")]
    common = max({each[k] for k in own}, key=[each[k] for k in own].count, default=1)
    own = [k for k in own if each[k] == common]
    lo, hi, a, b = ([float(signals[k][x]) for k in own] for x in ("dmin", "dmax", "pmin", "pmax"))
    gain = tuple((q - p) / (h - g) for g, h, p, q in zip(lo, hi, a, b, strict=True))
    records = (size - int(head["bytes"])) // (2 * max(1, sum(each)))
    rows = tuple(tuple(range(int(starts[k]), int(starts[k]) + common)) for k in own)
    return Header(path, stem(path), common / float(head["seconds"]), tuple(signals[k]["label"][4:] for k in own), rows, records * common, 1, path, int(head["bytes"]), "<i2", int(sum(each)), gain, tuple(p - g * d for p, g, d in zip(a, gain, lo, strict=True)))


READERS = {"set": set_header, "raw": raw_header, "edf": edf_header}


def header(path: str) -> Header:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"unsupported recording type {kind}")
    return READERS[kind](path)


def slab(h: Header, first: int, last: int) -> np.ndarray:
    """Records first to last - 1 as records by numbers; only their bytes are read."""
    width = np.dtype(h.kind).itemsize * h.wide
    if not h.split:
        with opened(h.path) as f:
            found = matlab.elements(f.read())
        data = (found["EEG"][0] if isinstance(found.get("EEG"), list) else found)["data"]
        return data.array().reshape(h.wide, -1, order="F").T[first:last]
    with opened(h.data) as f:
        raw = f.read_at((last - first) * width, h.offset + first * width)
    return np.frombuffer(raw, h.kind, len(raw) // width * h.wide).reshape(-1, h.wide)


@dataclass
class Slab(InputPartition):
    head: Header
    first: int
    last: int
    channels: tuple[int, ...]


class RecordingReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], numbers: int, headers: bool):
        self.paths, self.numbers, self.headers = list(paths), numbers, headers
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Channels and subjects that are asked for by name; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in ("channel", "subject") and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & own if name in self.wanted else own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Headers are read here, several at a time; data only by tasks."""
        names = self.wanted.get("subject")
        paths = [p for p in self.paths if names is None or stem(p) in names]
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(header, paths))
        out: list[InputPartition] = []
        for h in heads:
            own = tuple(k for k, c in enumerate(h.channels) if "channel" not in self.wanted or c in self.wanted["channel"])
            if not own:
                continue
            if self.headers:
                out.append(Slab(h, 0, 0, own))
                continue
            step = max(1, self.numbers // max(1, h.wide)) if h.split else max(1, h.records)
            out += [Slab(h, k, min(k + step, h.records), own) for k in range(0, h.records, step)]
        return out or [Slab(Header("", "", 0.0, (), (), 0, 0, "", 0, "<f4", 1, (), ()), 0, 0, ())]

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        h = part.head
        if self.headers:
            n = len(part.channels)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([h.subject] * n), pa.array([h.path] * n), pa.array([h.channels[k] for k in part.channels]), pa.array([h.rate] * n), pa.array([h.epochs] * n, pa.int32()), pa.array([h.samples] * n, pa.int64())], ["subject", "path", "channel", "rate", "epochs", "samples"])
            return
        if not part.channels:
            return
        records = slab(h, part.first, part.last)
        for k in part.channels:
            value = records[:, list(h.rows[k])].astype(float).ravel() * h.gain[k] + h.shift[k]
            at = part.first * len(h.rows[k]) + np.arange(len(value))
            same = pa.repeat(pa.scalar(h.subject), len(value)), pa.repeat(pa.scalar(h.channels[k]), len(value)), pa.repeat(pa.scalar(h.rate), len(value))
            yield pa.RecordBatch.from_arrays([*same, pa.array((at // h.samples).astype(np.int32)), pa.array(at % h.samples), pa.array(value)], ["subject", "channel", "rate", "epoch", "sample", "value"])


class Recordings(DataSource):
    """Format `recordings`: .set (with or without .fdt), unsegmented .raw and .edf files by path, folder or pattern.

    Options: slab, the numbers a task reads at most, about (one record at least; default four million); headers = true
    gives a row for each channel and opens no data. With spark.sql.python.filterPushdown.enabled, conditions on subject
    keep files unread and those on channel keep other channels from being made rows.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def only_headers(self) -> bool:
        return str(self.options.get("headers", "false")).lower() == "true"

    def schema(self) -> str:
        return HEADERS if self.only_headers() else SAMPLES

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(listed(self.options["path"]), int(self.options.get("slab", 1 << 22)), self.only_headers())


def read_slabs(spark: SparkSession, path: str, slab: int = 1 << 22, headers: bool = False):
    """subject, channel, rate, epoch, sample, value of recordings; or their headers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").option("slab", slab).option("headers", str(headers).lower()).load(path)
