"""Best-fit packing by non-negative least squares over patterns of a few documents' lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import map_texts, materialize, table
from latticework.llm.tokens import BYTE_BPE, encoder, vocabulary

CAPACITY = 2048
END_ID = 0


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices of whole texts (column 1) that hold `most` bytes at most; a longer text makes a slice alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID, slice_bytes: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the piece's place among those of its length in its task. A batch is encoded at once, or in slices of slice_bytes."""
    vocab = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in (s for batch in batches for s in (slices(batch, slice_bytes) if slice_bytes else [batch])):
            ids, ends = encoder(vocab).encode_array(b.column(1), end_id)
            out = []
            for doc_id, first, end in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                at, size, k = first, (end - first - 1) % capacity + 1, 0
                while at < end:
                    out.append((doc_id, k, at - first, size, zlib.crc32(ids[at : at + size]), seen[size]))
                    seen[size] += 1
                    at, size, k = at + size, capacity, k + 1
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(out), part, np.int64))], [*names, "part"])

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, nth long, part long"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def patterns(counts: np.ndarray, capacity: int, gap: int = 16) -> list[tuple[int, ...]]:
    """All patterns of two and of three lengths, longest first, that fill a sequence but for `gap` tokens at most; counts[n] is how many pieces have n tokens.

    For every choice of all lengths but the shortest, the shortest is the longest one there that fits; of the choices that
    share their longest length, those that leave the least free are patterns. None is drawn; there are about
    capacity**2 / 12 at most.
    """
    have = np.flatnonzero(counts[:capacity])
    have = have[have > 0]
    if not len(have):
        return []
    most = have[np.maximum(0, np.searchsorted(have, np.arange(capacity), side="right") - 1)]  # the longest length there up to n
    most[: have[0]] = 0

    def closed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows of `first` with their shortest length, at most `last`, where little stays free."""
        rest = capacity - first.sum(axis=1)
        fits = rest > 0
        first, rest, last = first[fits], rest[fits], last[fits]
        end = most[np.minimum(rest, last)]
        free = np.where(end > 0, rest - end, capacity)
        least = np.full(capacity, capacity)
        np.minimum.at(least, first[:, 0], free)
        full = (free <= gap) & (free == least[first[:, 0]])
        return np.column_stack([first[full], end[full]])

    pairs = closed(have[:, None], have)
    i, j = np.nonzero(np.tri(len(have), dtype=bool) & (have[:, None] + have[None] < capacity))
    triples = closed(np.column_stack([have[i], have[j]]), have[j])
    return [tuple(p) for p in (*pairs.tolist(), *triples.tolist())]


def least_squares(use: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of their pieces to the histogram: projected, accelerated gradient steps."""
    width = max(map(len, use))
    idx = np.array([[*p, *[0] * (width - len(p))] for p in use])
    weight = np.where(idx > 0, 1.0, 0.0)
    target = counts.astype(float)
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(idx.ravel(), (weight * x[:, None]).ravel(), len(counts))

    v = np.ones(len(use))
    for _ in range(30):  # largest eigenvalue
        v = (weight * forward(v)[idx]).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(use))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - (weight * (forward(y) - target)[idx]).sum(axis=1) / norm)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences use each; they hold exactly the histogram's pieces.

    Fitted counts are rounded so that their running sum keeps within one, limited to what is there, and the residual pieces go, longest first, to the fullest
    sequence with room: sequences with equal room are one entry, so work depends on the capacity and not on the number
    of pieces. Full pieces stand alone.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    use = patterns(left, capacity)
    if use:
        fitted = least_squares(use, left)
        order = np.argsort(-fitted, kind="stable")
        fitted[order] = np.diff(np.floor(np.cumsum(fitted[order]) + 1e-6), prepend=0.0)
        for k in order[fitted[order] > 0]:
            need = Counter(use[k])
            times = min(int(fitted[k]), *(int(left[n]) // c for n, c in need.items()))
            if times > 0:
                out.append((use[k], times))
                for n, c in need.items():
                    left[n] -= c * times
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(room: int, entry: tuple[tuple[int, ...], int]) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append(entry)

    for n in range(capacity - 1, 0, -1):
        todo = int(left[n])
        while todo:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                full, rest = divmod(todo, each)
                if full:
                    put(capacity - each * n, ((n,) * each, full))
                if rest:
                    put(capacity - rest * n, ((n,) * rest, 1))
                break
            room = rooms[k]
            items, count = groups[room].pop()
            each = min(room // n, todo)
            times = min(count, todo // each)
            if not groups[room]:
                rooms.pop(k)
            if count > times:
                put(room, (items, count - times))
            put(room - each * n, (items + (n,) * each, times))
            todo -= each * times
    return out + [e for room in sorted(groups) for e in groups[room]]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID, slice_bytes: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Only the histogram of lengths, `capacity` numbers, reaches the driver. The k-th piece of a length takes the k-th
    place that the plan has for it; k is the piece's number in its task plus the counts of the tasks before, so no
    length is gathered anywhere. Null and empty texts hold just the end id; equal rows are packed one by one.
    Texts of any length are encoded whole, other columns don't matter, and an empty table gives an empty result.
    slice_bytes: encode about so many bytes of texts at once, which takes less memory and more time.
    """
    own = materialize(pieces(docs, capacity, tokenizer, end_id, slice_bytes), "pieces")
    per = own.groupBy("part", "length").agg(F.count("*").alias("n"))
    per = materialize(per, "lengths")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken, base = Counter(), 0
    for items, times in plan(histogram, capacity):
        offset = 0
        for n in items:
            places[n].append((taken[n], base, offset))
            taken[n] += times
            offset += n
        base += times
    table_of = {n: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for n, v in places.items()}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                m = length == n
                first, start, offset = table_of[int(n)]
                k = np.searchsorted(first, rank[m], side="right") - 1
                seq[m], off[m] = start[k] + rank[m] - first[k], offset[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    near = own.join(before.hint("merge"), ["part", "length"])  # tasks times lengths: grows with the documents
    ranked = near.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
