"""Multitaper cross-spectra of whole epochs, added up as channel-by-channel blocks, and phase connectivity from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.signal import tapers


def channel_names(df: DataFrame) -> list[str]:
    """The montage in lexicographic order: a few hundred names at most."""
    return [r[0] for r in df.select("channel").filter("channel is not null").distinct().orderBy("channel").collect()]


class Sums:
    """Sums over epochs, for each frequency: of the cross-spectrum's imaginary part, its size and its square for the channel pairs, of power for the channels; and how many epochs held each pair and channel."""

    def __init__(self, channels: int, own: np.ndarray, size: int, rate: float, lo: float, hi: float):
        self.own, self.size = own, size
        freqs = np.fft.rfftfreq(size, 1 / rate)
        self.pick = np.flatnonzero((freqs >= lo) & (freqs <= hi))
        self.marks, self.rate = freqs[self.pick], rate
        self.upper = np.triu_indices(channels, 1)
        pairs, bins = len(self.upper[0]), len(self.pick)
        self.cross, self.power = np.zeros((bins, 3, pairs)), np.zeros((bins, channels))
        self.seen, self.together = np.zeros(channels), np.zeros(pairs)

    def add(self, epoch: np.ndarray, held: np.ndarray, at_once: int = 64) -> None:
        """An epoch of channels by samples; the cross-spectra of `at_once` frequencies are held at a time."""
        present = held.any(axis=1)
        waves = np.fft.rfft(self.own[:, None] * epoch[None], self.size)[:, :, self.pick].transpose(2, 1, 0)  # bins, channels, tapers
        i, j = self.upper
        for at in range(0, len(waves), at_once):
            some = waves[at : at + at_once]
            imaginary = (some @ some.conj().transpose(0, 2, 1)).imag[:, i, j] / len(self.own)
            sums = self.cross[at : at + at_once]
            sums[:, 0] += imaginary
            sums[:, 1] += np.abs(imaginary)
            sums[:, 2] += imaginary**2
        self.power += (np.abs(waves) ** 2).mean(axis=2) * 2 / self.rate
        self.seen += present
        self.together += present[i] * present[j]

    def blocks(self) -> list[bytes]:
        """One block for each frequency."""
        return [np.concatenate([c.ravel(), self.together, p, self.seen]).tobytes() for c, p in zip(self.cross, self.power, strict=True)]


def cross_blocks(df: DataFrame, channels: Sequence[str], rate: float, n: int, smoothing: float = 0.3, lo: float = 0.5, hi: float = 45.0, keys: Sequence[str] = ("subject",), windows: np.ndarray | None = None) -> DataFrame:
    """keys, freq, block: all epochs' Sums of each key and frequency, from samples (keys, channel, epoch, sample, value).

    Samples are shuffled once, so that each epoch's channels meet, sorted by key and epoch. A task puts an epoch together,
    takes the tapers' Fourier transforms of all its channels and adds the outer products at each frequency to its key's
    sums; what leaves it is a block for each key and frequency, and blocks are added as they stream by. No row stands
    for a sample and a frequency, channels are never joined, and the epochs of one key are dealt to many tasks. Missing
    samples count 0, repeated ones add up; nulls, samples beyond n and channels that aren't listed take no part. Epochs
    are padded to the next power of two, but if `windows` are given instead of tapers.
    """
    own = tapers(n, max(1.0, smoothing * n / rate)) if windows is None else windows
    size = 1 << (n - 1).bit_length() if windows is None else n
    return epoch_blocks(df, channels, n, keys, "freq double", lambda: Sums(len(channels), own, size, rate, lo, hi))


def epoch_blocks(df: DataFrame, channels: Sequence[str], n: int, keys: Sequence[str], mark: str, make: Callable) -> DataFrame:
    """keys, a mark (its name and type are given) and block: the sums over all epochs of each key, from samples (keys, channel, epoch, sample, value).

    make() gives empty sums for a key: add(epoch, held) takes an epoch, channels by samples, and which samples it holds;
    marks names what blocks() lists. Epochs are put together as cross_blocks says.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) - 1 if channels else F.lit(-1)
    rows = df.filter(F.col("value").isNotNull() & F.col("sample").between(0, n - 1) & F.col("channel").isNotNull())
    rows = rows.select(*keys, "epoch", place.cast("int").alias("_ch"), F.col("sample").cast("int").alias("_at"), F.col("value").cast("double").alias("_x"), F.xxhash64(F.lit(0), *keys).alias("_key"), F.xxhash64(*keys, "epoch").alias("_part")).filter("_ch >= 0")
    ordered = rows.repartition(*keys, "epoch").sortWithinPartitions(*keys, "epoch").select(*keys, "_ch", "_at", "_x", "_key", "_part")
    name = mark.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        key = part = names = None
        epoch, held = np.zeros((len(channels), n)), np.zeros((len(channels), n), bool)

        def out() -> pa.RecordBatch:
            made = sums.blocks()
            return pa.RecordBatch.from_arrays([*[pa.array([v] * len(made), t) for v, t in names], pa.array(sums.marks), pa.array(made, pa.binary())], [*keys, name, "block"])

        for b in batches:
            if not b.num_rows:
                continue
            of_key, of_part, ch, at, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_part", "_ch", "_at", "_x"))
            edges = [0, *(np.flatnonzero((of_part[1:] != of_part[:-1]) | (of_key[1:] != of_key[:-1])) + 1).tolist(), b.num_rows]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if sums is not None and (of_key[first], of_part[first]) != (key, part):
                    sums.add(epoch, held)
                    epoch[:], held[:] = 0, False
                    if of_key[first] != key:
                        yield out()
                        sums = None
                if sums is None:
                    sums = make()
                    names = [(b.column(k)[first].as_py(), b.column(k).type) for k in keys]
                key, part = of_key[first], of_part[first]
                np.add.at(epoch, (ch[first:end], at[first:end]), x[first:end])
                held[ch[first:end], at[first:end]] = True
        if sums is not None:
            sums.add(epoch, held)
            yield out()

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + f"{mark}, block binary"
    return added_blocks(ordered.mapInArrow(run, schema), [*keys, name], schema)


def added_blocks(df: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """One block for each key, the sum of its blocks, which come sorted and are held one at a time."""
    ordered = df.repartition(*keys).withColumn("_key", F.xxhash64(*keys)).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = names = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in names], pa.array([total.tobytes()], pa.binary())], [*keys, "block"])

        for b in batches:
            for k in range(b.num_rows):
                own, block = b.column("_key")[k].as_py(), np.frombuffer(b.column("block")[k].as_py())
                if total is not None and own == key:
                    total += block
                else:
                    if total is not None:
                        yield out()
                    key, total, names = own, block.copy(), [(b.column(c)[k].as_py(), b.column(c).type) for c in keys]
        if total is not None:
            yield out()

    return ordered.mapInArrow(run, schema)


def unpacked(block: bytes, channels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(im, |im|, im squared) by pair, epochs by pair, power and epochs by channel."""
    pairs = channels * (channels - 1) // 2
    flat = np.frombuffer(block)
    return flat[: 3 * pairs].reshape(3, pairs), flat[3 * pairs : 4 * pairs], flat[4 * pairs : 4 * pairs + channels], flat[4 * pairs + channels :]


def block_wpli(blocks: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, freq, ch_i, ch_j, w: debiased weighted phase lag index over epochs, ch_i before ch_j; null where no epoch tells, no row for pairs that no epoch holds."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    i, j = np.triu_indices(len(channels), 1)
    names = pa.array(channels, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (s, a, q), together, _, _ = unpacked(b.column("block")[k].as_py(), len(channels))
                held = np.flatnonzero(together)
                top, below = (s**2 - q)[held], (a**2 - q)[held]
                w = pa.array(np.divide(top, below, out=np.zeros_like(top), where=below != 0), mask=below == 0)
                same = [pa.repeat(b.column(c)[k], len(held)) for c in (*keys, "freq")]
                yield pa.RecordBatch.from_arrays([*same, names.take(pa.array(i[held])), names.take(pa.array(j[held])), w], [*keys, "freq", "ch_i", "ch_j", "w"])

    return blocks.mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "freq double, ch_i string, ch_j string, w double")


def block_power(blocks: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, freq, channel, power: the mean over the epochs that hold the channel and over tapers."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    names = pa.array(channels, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, _, power, seen = unpacked(b.column("block")[k].as_py(), len(channels))
                held = np.flatnonzero(seen)
                same = [pa.repeat(b.column(c)[k], len(held)) for c in (*keys, "freq")]
                yield pa.RecordBatch.from_arrays([*same, names.take(pa.array(held)), pa.array(power[held] / seen[held])], [*keys, "freq", "channel", "power"])

    return blocks.mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "freq double, channel string, power double")
