"""Independent components of recordings of any length: sums over blocks of samples, a small state for each recording."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.keyed import same_keys
from latticework.session import kept

#: The change of a direction below which a recording's search ends.
SETTLED = 1e-8
#: Arrow batches of blocks hold about so many bytes, or one block.
BATCH_BYTES = 8 << 20


class Search:
    """A recording's state: mean, whitening and its inverse, directions w; what its blocks must add up next, and what follows from the sums."""

    def __init__(self, seed: int, rounds: int):
        self.step, self.seed, self.left = "mean", seed, rounds

    def part(self, x: np.ndarray) -> np.ndarray:
        """The sums of a block, channels by samples, that this step needs."""
        if self.step == "mean":
            return np.append(x.sum(axis=1), x.shape[1])
        x = x - self.mean[:, None]
        if self.step == "spread":
            return (x @ x.T).ravel()
        z = self.white @ x
        if self.step == "turn":
            t = np.tanh(self.w @ z)
            return np.append((t @ z.T).ravel(), (1 - t * t).sum(axis=1))
        return ((self.w @ z) ** 4).sum(axis=1)

    def follow(self, sums: np.ndarray) -> None:
        """Moves on with the sums over all blocks."""
        if self.step == "mean":
            self.n = sums[-1]
            self.mean, self.step = sums[:-1] / max(self.n, 1), "spread"
        elif self.step == "spread":
            c = len(self.mean)
            spread = sums.reshape(c, c)
            if self.n < 2 or not np.diag(spread).any():
                self.step, self.w = "done", None  # nothing to take apart
                return
            u, s, _ = np.linalg.svd(spread / (self.n - 1))
            keep = s > s[0] * 1e-10
            self.white, self.back = (u[:, keep] / np.sqrt(s[keep])).T, u[:, keep] * np.sqrt(s[keep])
            self.w = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(keep.sum(), keep.sum())))[0]
            self.step = "turn" if self.left else "order"
        elif self.step == "turn":
            k = len(self.w)
            a, _, b = np.linalg.svd(sums[: k * k].reshape(k, k) / self.n - sums[k * k :, None] / self.n * self.w)
            old, self.w = self.w, a @ b
            self.left -= 1
            if not self.left or np.abs(np.abs((self.w * old).sum(axis=1)) - 1).max() < SETTLED:
                self.step = "order"
        else:
            self.rank = np.argsort(-np.abs(sums / self.n - 3), kind="stable")
            self.step = "done"

    def less(self, x: np.ndarray, reject: Sequence[int]) -> np.ndarray:
        """A block rebuilt without the rejected components; samples that lack a channel are NaN throughout."""
        if self.w is None:
            return x
        stay = np.ones(len(self.w))
        stay[self.rank[[k for k in reject if k < len(stay)]]] = 0
        return self.back @ self.w.T @ (stay[:, None] * (self.w @ (self.white @ (x - self.mean[:, None])))) + self.mean[:, None]


def complete(x: np.ndarray) -> np.ndarray:
    """The samples that no channel lacks."""
    return x[:, ~np.isnan(x).any(axis=0)]


def independent_components(df: DataFrame, keys: Sequence[str] = ("subject",), reject: Sequence[int] = (), rounds: int = 200, seed: int = 1, block: int = 1 << 13) -> DataFrame:
    """(keys, channel, sample, value) rebuilt from a recording's independent components less the rejected ones.

    Components come by symmetric fixed-point iteration with tanh, in falling order of their absolute excess kurtosis.
    Samples must be numbered through the recording; those that lack one of its channels, or have a null or NaN there, have no
    row in the result, and repeated ones are averaged. A recording that can't be taken apart, as it has fewer than two
    complete samples or is flat, keeps all values it has.

    A task holds one block of `block` samples, channels by samples. Recordings of one block are searched where they lie.
    Of longer ones each round adds up what its blocks tell, a channels-by-channels matrix for each task and recording,
    and the new directions are written; so no recording meets in one task, and lost executors cost a round at most.
    """
    keys = list(keys)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    typed = "".join(f"{k} {kinds[k]}, " for k in keys)
    rows = df.filter("channel is not null and sample is not null and value is not null and not isnan(value)")
    names = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("channel")).alias("_names"), (F.min(F.floor(F.col("sample") / block)) == F.max(F.floor(F.col("sample") / block))).alias("_single"))  # a montage for each recording
    dealt = same_keys(rows.select(*keys, "channel", "sample", F.col("value").cast("double").alias("value")), names, keys)

    def put(t: pa.Table) -> pa.Table:
        montage = t["_names"][0].as_py()
        place = {c: k for k, c in enumerate(montage)}
        at, where = np.unique(t["sample"].to_numpy(), return_inverse=True)
        ch = np.fromiter((place[c] for c in t["channel"].to_pylist()), int, t.num_rows)
        total, count = np.zeros((len(montage), len(at))), np.zeros((len(montage), len(at)))
        np.add.at(total, (ch, where), t["value"].to_numpy())
        np.add.at(count, (ch, where), 1)
        x, single = np.where(count > 0, total / np.maximum(count, 1), np.nan), t["_single"][0].as_py()
        state = None
        if single:
            search = Search(seed, rounds)
            while search.step != "done":
                search.follow(search.part(complete(x)))
            state = pickle.dumps(search)
        return pa.table({**{k: pa.array([t[k][0].as_py()], t[k].type) for k in keys}, "names": pa.array([montage], pa.list_(pa.string())), "at": pa.array([at.astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "own": pa.array([state], pa.binary())})

    schema = f"{typed}names array<string>, at binary, x binary, own binary"
    parts = kept(dealt.groupBy(*keys, F.floor(F.col("sample") / block).alias("_block")).applyInArrow(put, schema), "components")
    state = _searched(parts.filter("own is null"), keys, typed, seed, rounds)
    long = same_keys(parts.filter("own is null").drop("own"), state, keys).select(*keys, "names", "at", "x", F.col("state").alias("own"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                montage, at = b.column("names")[k].as_py(), np.frombuffer(b.column("at")[k].as_py(), "<i8")
                out = pickle.loads(b.column("own")[k].as_py()).less(np.frombuffer(b.column("x")[k].as_py()).reshape(len(montage), len(at)), reject)
                for name, v in zip(montage, out, strict=True):
                    there = ~np.isnan(v)
                    n = int(there.sum())
                    yield pa.RecordBatch.from_arrays([*[pa.array([b.column(c)[k].as_py()] * n, b.column(c).type) for c in keys], pa.array([name] * n, pa.string()), pa.array(at[there]), pa.array(v[there])], [*keys, "channel", "sample", "value"])

    whole = parts.filter("own is not null").select(*keys, "names", "at", "x", "own").unionByName(long)
    return whole.mapInArrow(rebuilt, f"{typed}channel string, sample long, value double").withColumn("sample", F.col("sample").cast(kinds["sample"]))


def _searched(parts: DataFrame, keys: list[str], typed: str, seed: int, rounds: int) -> DataFrame:
    """keys, state (a pickled Search that is done) of the recordings of several blocks."""
    first = pickle.dumps(Search(seed, rounds))
    state = kept(parts.select(*keys).distinct().select(*keys, F.lit(bytearray(first)).alias("state"), F.lit(False).alias("done")), "search")
    done = []
    while state.take(1):
        sums = _sums(same_keys(parts.select(*keys, "names", "x"), state.select(*keys, "state"), keys), keys, typed)
        moved = same_keys(state.select(*keys, "state"), sums, keys).mapInArrow(_moved(keys), f"{typed}state binary, done boolean")
        moved = kept(moved, "search")
        if moved.filter("done").take(1):
            done.append(moved.filter("done"))
        state = moved.filter("not done")
    out = state
    for d in done:
        out = out.unionByName(d)
    return out.select(*keys, "state")


def _moved(keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, done = [], []
            for state, sums in zip(b.column("state").to_pylist(), b.column("block").to_pylist(), strict=True):
                search = pickle.loads(state)
                search.follow(np.frombuffer(sums))
                states.append(pickle.dumps(search))
                done.append(search.step == "done")
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(states, pa.binary()), pa.array(done)], [*keys, "state", "done"])

    return run


def _sums(parts: DataFrame, keys: list[str], typed: str) -> DataFrame:
    """keys, block: what all blocks of a recording add up to; a task adds up runs of blocks of one recording before they move."""
    from latticework.operators.spectra import added_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in key], pa.array([total.tobytes()], pa.binary())], [*keys, "block"])

        for b in batches:
            for k in range(b.num_rows):
                own = [(b.column(c)[k].as_py(), b.column(c).type) for c in keys]
                x = np.frombuffer(b.column("x")[k].as_py()).reshape(len(b.column("names")[k]), -1)
                sums = pickle.loads(b.column("state")[k].as_py()).part(complete(x))
                if total is not None and own == key:
                    total += sums
                else:
                    if total is not None:
                        yield out()
                    key, total = own, sums
        if total is not None:
            yield out()

    schema = f"{typed}block binary"
    return added_blocks(parts.mapInArrow(run, schema), keys, schema)

