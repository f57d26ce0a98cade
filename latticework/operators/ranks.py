"""Rank statistics of all group pairs from one running count: scores range-partitioned, sorted blocks summed up, prefix offsets added."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of groups smaller than this together, the smaller one below LESSER, have an exact rank-sum p.
SMALL, LESSER = 20, 10


class Block:
    """What one key's ascending values leave, met so far in one task: counts by group, and for each pair of groups the statistic and ties within, the best thresholds and, of small pairs, the sizes of ties."""

    def __init__(self, n: np.ndarray, pairs: np.ndarray):
        self.n, (self.g0, self.g1) = n, pairs.T
        self.c = np.zeros(len(n))
        self.u, self.ties = np.zeros(len(pairs)), np.zeros(len(pairs))
        # largest and smallest E = before0 * n1 - before1 * n0, and the score, counts before and counts at it
        self.e = np.array([[-1 << 62], [1 << 62]]).repeat(len(pairs), axis=1)
        self.at = np.zeros((2, len(pairs), 5))
        self.small = [i for i in range(len(pairs)) if n[self.g0[i]] + n[self.g1[i]] < SMALL]
        self.sizes: list[list[float]] = [[] for _ in self.small]

    def take(self, score: np.ndarray, counts: np.ndarray) -> None:
        before = self.c + np.cumsum(counts, axis=0) - counts
        w = (before + counts / 2).T @ counts
        cubes, mixed, sums = (counts**3).sum(axis=0), (counts**2).T @ counts, counts.sum(axis=0)
        self.u += w[self.g0, self.g1]
        self.ties += (cubes - sums)[self.g0] + (cubes - sums)[self.g1] + 3 * (mixed[self.g0, self.g1] + mixed[self.g1, self.g0])
        whole = before.astype(np.int64)
        n = self.n.astype(np.int64)
        for i, (a, b) in enumerate(zip(self.g0, self.g1, strict=True)):
            held = np.flatnonzero(counts[:, a] + counts[:, b])
            if not len(held):
                continue
            e = whole[held, a] * n[b] - whole[held, b] * n[a]
            last = len(e) - 1
            for side, k in ((0, last - int(e[::-1].argmax())), (1, last - int(e[::-1].argmin()))):  # the larger score of equals
                if (e[k] >= self.e[0, i]) if side == 0 else (e[k] <= self.e[1, i]):
                    v = held[k]
                    self.e[side, i], self.at[side, i] = e[k], (score[v], before[v, a], before[v, b], counts[v, a], counts[v, b])
        for own, i in zip(self.sizes, self.small, strict=True):
            t = counts[:, self.g0[i]] + counts[:, self.g1[i]]
            own += t[t > 0].tolist()
        self.c += sums

    def row(self) -> dict:
        return {"n": self.n.tolist(), "c": self.c.tolist(), "u": self.u.tolist(), "ties": self.ties.tolist(), "e": self.e.ravel().tolist(), "at": self.at.ravel().tolist(), "small": self.small, "sizes": self.sizes}


_BLOCK = "n array<double>, c array<double>, u array<double>, ties array<double>, e array<long>, at array<double>, small array<int>, sizes array<array<double>>"
_BLOCK_TYPES = [("n", pa.list_(pa.float64())), ("c", pa.list_(pa.float64())), ("u", pa.list_(pa.float64())), ("ties", pa.list_(pa.float64())), ("e", pa.list_(pa.int64())), ("at", pa.list_(pa.float64())), ("small", pa.list_(pa.int32())), ("sizes", pa.list_(pa.list_(pa.float64())))]


def exact_p(sizes: Sequence[float], n0: int, n1: int, u: float) -> float:
    """Two-sided exact p of U with ties, by counting the subsets of doubled mid-ranks: twice the smaller tail, 1 at most."""
    doubled, start = [], 0
    for t in sizes:
        doubled += [int(2 * start + t + 1)] * int(t)
        start += t
    ways = np.zeros((n1 + 1, sum(doubled) + 1))
    ways[0, 0] = 1
    for r in doubled:
        ways[1:, r:] += ways[:-1, : ways.shape[1] - r].copy()
    of = ways[n1] / ways[n1].sum()
    seen = round(2 * u) + n1 * (n1 + 1)  # the doubled rank sum
    return float(min(1.0, 2 * min(of[: seen + 1].sum(), of[seen:].sum())))


def group_list(df: DataFrame, grp: str) -> list:
    """The groups in order: few, by the design of a study."""
    return sorted(r[0] for r in df.select(grp).filter(F.col(grp).isNotNull()).distinct().collect())


def pair_ranks(df: DataFrame, keys: Sequence[str], grp: str = "grp", score: str = "score", weight: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """keys, g0, g1, n0, n1, u, ties, threshold, fp_at, tp_at, at0, at1, exact_p for each key and pair of groups g0 < g1 it holds.

    u counts the pairs in which g1's score is higher, ties half; ties is the sum of t^3 - t. threshold is the score where
    the rates of g1 and of g0 at it or above differ most, the larger of equals, with its counts fp_at (g0) and tp_at
    (g1), at0 and at1 of them equal to it. exact_p is the rank-sum p of small groups, else null.

    Equal scores of a key become one row with a count for each group, so ties shrink before anything is sorted. Rows are
    range-partitioned by key and score; each task goes once through its sorted rows, whatever keys they belong to, and
    leaves one summary for each key. Summaries are put in order by key and block, and what all blocks before have counted
    is added as they stream by. No pair of groups has rows of its own and no key is sorted in one task. Rows without a
    group or score take no part; NaN is the largest score.
    """
    groups = group_list(df, grp)
    listed = list(combinations(groups, 2)) if pairs is None else sorted((r["g0"], r["g1"]) for r in pairs.collect())
    place = {g: k for k, g in enumerate(groups)}
    at = np.array([(place[a], place[b]) for a, b in listed if a in place and b in place], int).reshape(-1, 2)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.filter(F.col(grp).isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(grp).alias("_g"), (F.col(score).cast("double") + 0.0).alias("_s"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    counts = [F.sum(F.when(F.col("_g") == F.lit(g), F.col("_w")).otherwise(0.0)) for g in groups] or [F.lit(0.0)]
    per_value = rows.groupBy(*keys, "_s").agg(F.array(*counts).alias("_c"))
    totals = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array(*counts).alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = per_value.join(totals, same).select(*keys, "_s", "_c", "_n", F.xxhash64(F.lit(0), *keys).alias("_key"))
    ordered = joined.repartitionByRange(*keys, "_s").sortWithinPartitions(*keys, "_s")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = names = None
        schema = pa.schema([("_part", pa.int32()), *_BLOCK_TYPES])
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([{"_part": part, **block.row()}], schema=schema)
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in names], *made.columns], [*keys, *schema.names])

        for b in batches:
            if not b.num_rows:
                continue
            own, s = b.column("_key").to_numpy(zero_copy_only=False), b.column("_s").to_numpy(zero_copy_only=False)
            c = b.column("_c").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b.num_rows]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if block is None or own[first] != key:
                    if block is not None:
                        yield out()
                    key, names = own[first], [(b.column(k)[first].as_py(), b.column(k).type) for k in keys]
                    block = Block(np.array(b.column("_n")[first].as_py()), at)
                block.take(s[first:end], c[first:end])
        if block is not None:
            yield out()

    own_keys = "".join(f"{k} {kinds[k]}, " for k in keys)
    blocks = ordered.mapInArrow(summaries, f"{own_keys}_part int, {_BLOCK}")
    gathered = blocks.withColumn("_key", F.xxhash64(F.lit(0), *keys)).repartition("_key").sortWithinPartitions("_key", "_part")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = names = None
        total: dict = {}

        def out() -> pa.RecordBatch:
            made: dict[str, list] = {c: [] for c in ("_i", "n0", "n1", "u", "ties", "threshold", "fp_at", "tp_at", "at0", "at1", "exact_p")}
            for i, (a, b) in enumerate(at.tolist()):
                n0, n1 = total["n"][a], total["n"][b]
                if not n0 or not n1:
                    continue
                small = n0 + n1 < SMALL and min(n0, n1) < LESSER
                p = exact_p(total["sizes"][i], int(n0), int(n1), total["u"][i]) if small else None
                for c, v in zip(made, (i, n0, n1, total["u"][i], total["ties"][i], *total["best"][i][1:], p), strict=True):
                    made[c].append(v)
            kept = len(made["_i"])
            return pa.RecordBatch.from_arrays([*[pa.array([v] * kept, t) for v, t in names], *[pa.array(v, pa.int32() if c == "_i" else pa.float64()) for c, v in made.items()]], [*keys, *made])

        for b in batches:
            for k, r in enumerate(b.select(["_key", "n", "c", "u", "ties", "e", "at", "small", "sizes"]).to_pylist()):
                if r["_key"] != key:
                    if key is not None:
                        yield out()
                    key, names = r["_key"], [(b.column(c)[k].as_py(), b.column(c).type) for c in keys]
                    total = {"n": r["n"], "c": np.zeros(len(r["n"])), "u": np.zeros(len(at)), "ties": np.zeros(len(at)), "best": [(-1, 0.0)] * len(at), "sizes": [[] for _ in at]}
                c, before, n = np.array(r["c"]), total["c"], [int(x) for x in r["n"]]
                total["u"] += np.array(r["u"]) + before[at[:, 0]] * c[at[:, 1]]
                total["ties"] += np.array(r["ties"])
                e, spots = np.array(r["e"], np.int64).reshape(2, -1), np.array(r["at"]).reshape(2, -1, 5)
                for i, (g0, g1) in enumerate(at.tolist()):
                    off0, off1 = int(before[g0]), int(before[g1])
                    for side in (0, 1):
                        if abs(int(e[side, i])) == 1 << 62:
                            continue
                        score, b0, b1, c0, c1 = spots[side, i].tolist()
                        gap = abs(int(e[side, i]) + off0 * n[g1] - off1 * n[g0])
                        if (gap, 0 if score == score else 1, score) >= (total["best"][i][0], 0 if total["best"][i][1] == total["best"][i][1] else 1, total["best"][i][1]):
                            total["best"][i] = (gap, score, n[g0] - off0 - b0, n[g1] - off1 - b1, c0, c1)
                for i, sizes in zip(r["small"], r["sizes"], strict=True):
                    total["sizes"][i] += sizes
                total["c"] = before + c
        if key is not None:
            yield out()

    found = gathered.mapInArrow(combined, f"{own_keys}_i int, n0 double, n1 double, u double, ties double, threshold double, fp_at double, tp_at double, at0 double, at1 double, exact_p double")
    name = lambda column: F.get(F.array(*[F.lit(listed[i][column]) for i in range(len(listed))]), F.col("_i")).cast(kinds[grp])
    if not listed:
        return found.withColumns({"g0": F.lit(None).cast(kinds[grp]), "g1": F.lit(None).cast(kinds[grp])}).drop("_i")
    return found.select(*keys, name(0).alias("g0"), name(1).alias("g1"), "n0", "n1", "u", "ties", "threshold", "fp_at", "tp_at", "at0", "at1", "exact_p")
