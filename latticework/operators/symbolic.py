"""Weighted symbolic mutual information of all channel pairs, at all time constants at once, as channel-by-channel blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.operators.spectra import epoch_blocks

#: Patterns of three samples, and each one's mirror image, the pattern of reversed signs.
PATTERNS = 6
MIRROR = np.array([5, 4, 3, 2, 1, 0])


def patterns(epoch: np.ndarray, held: np.ndarray, tau: int) -> np.ndarray:
    """The order pattern (0 to 5) of each three samples tau apart, ties by position; -1 where one of them is missing."""
    n = epoch.shape[1] - 2 * tau
    a, b, c = (epoch[:, k * tau : k * tau + n] for k in range(3))
    code = np.select([(a <= b) & (b <= c), (a <= c) & (c < b), (b < a) & (a <= c), (c < a) & (a <= b), (b <= c) & (c < a)], range(5), 5)
    return np.where(held[:, :n] & held[:, tau : tau + n] & held[:, 2 * tau :], code, -1)


class Information:
    """Sums over epochs of the pairs' weighted information, and how many epochs told of each pair, for every time constant."""

    def __init__(self, channels: int, taus: Sequence[int], at_once: int = 32):
        self.marks, self.at_once = np.array(taus, np.int32), at_once
        self.upper = np.triu_indices(channels, 1)
        self.sums = np.zeros((len(taus), 2, len(self.upper[0])))
        x = np.arange(PATTERNS)
        self.weight = ((x[:, None] != x[None]) & (x[None] != MIRROR[:, None])).astype(float)

    def add(self, epoch: np.ndarray, held: np.ndarray) -> None:
        """Joint counts of all pairs' patterns are one matrix product of their indicators; `at_once` channels' are held at a time."""
        for k, tau in enumerate(self.marks.tolist()):
            if epoch.shape[1] <= 2 * tau:
                continue
            code = patterns(epoch, held, tau)
            own = (code[:, None] == np.arange(PATTERNS)[None, :, None]).astype(np.float32)
            channels, flat = len(own), own.reshape(-1, own.shape[2])
            told, information = np.zeros((channels, channels)), np.zeros((channels, channels))
            for at in range(0, channels, self.at_once):
                some = own[at : at + self.at_once]
                joint = (some.reshape(-1, own.shape[2]) @ flat.T).reshape(len(some), PATTERNS, channels, PATTERNS).transpose(0, 2, 1, 3).astype(float)
                total = joint.sum(axis=(2, 3))
                chance = joint.sum(axis=3)[..., None] * joint.sum(axis=2)[:, :, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    terms = joint * np.log(joint * total[..., None, None] / chance)
                told[at : at + self.at_once] = total > 0
                weighed = (np.where(joint > 0, terms, 0.0) * self.weight).sum(axis=(2, 3))
                information[at : at + self.at_once] = weighed / np.maximum(total, 1.0) / np.log(PATTERNS)
            self.sums[k, 0] += information[self.upper]
            self.sums[k, 1] += told[self.upper]

    def blocks(self) -> list[bytes]:
        return [s.tobytes() for s in self.sums]


def information_blocks(df: DataFrame, channels: Sequence[str], n: int, taus: Sequence[int], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, tau, block: Information of all epochs of each key, from samples (keys, channel, epoch, sample, value) of epochs of n.

    Samples are shuffled once, so that an epoch's channels meet; what leaves a task is a block for each key and time
    constant, so neither a sample nor a pattern is ever joined or stored for a pair. Three samples make a pattern only if
    all are there; repeated samples add up; nulls, samples beyond n and channels that aren't listed take no part.
    """
    return epoch_blocks(df, channels, n, keys, "tau int", lambda: Information(len(channels), taus))


def block_information(blocks: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, tau, ch_i, ch_j, w: the mean over the epochs that tell of a pair, not below 0, ch_i before ch_j; no row for pairs that no epoch tells of, nor for time constants whose three samples exceed an epoch."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    i, j = np.triu_indices(len(channels), 1)
    names = pa.array(channels, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                total, told = np.frombuffer(b.column("block")[k].as_py()).reshape(2, -1)
                held = np.flatnonzero(told)
                same = [pa.repeat(b.column(c)[k], len(held)) for c in (*keys, "tau")]
                w = pa.array(np.maximum(total[held] / told[held], 0.0))
                yield pa.RecordBatch.from_arrays([*same, names.take(pa.array(i[held])), names.take(pa.array(j[held])), w], [*keys, "tau", "ch_i", "ch_j", "w"])

    return blocks.mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "tau int, ch_i string, ch_j string, w double")
