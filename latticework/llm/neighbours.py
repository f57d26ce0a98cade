"""Approximate nearest neighbours: p-stable hashing with query-directed probing and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import discard, hash_share, materialize, table, written

#: Vectors to set the bucket width by, at most about so many; chosen by a hash of the id.
SAMPLE = 2000


class PStable:
    """Tables of `bits` projections cut into slots of one width, the same for a seed and a dimension."""

    def __init__(self, dimension: int, width: float, tables: int, bits: int, seed: int = 17):
        rng = np.random.default_rng([seed, dimension])
        self.a = rng.standard_normal((dimension, tables * bits))
        self.b = rng.random(tables * bits) * width
        self.width, self.tables, self.bits = width, tables, bits
        self.mix = rng.integers(1, 2**62, size=bits, dtype=np.int64) | 1

    def slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers and places within the slot (0 to 1), by row, table and projection."""
        y = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.bits)
        low = np.floor(y)
        return low.astype(np.int64), y - low

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """Buckets as 32-bit numbers; two that share a number only share their candidates."""
        with np.errstate(over="ignore"):
            return ((slots * self.mix).sum(axis=-1) >> 29).astype(np.uint32)

    def probes(self, place: np.ndarray, n: int) -> list[np.ndarray]:
        """Shifts of one table's slots, surest first: sets of single steps in order of the squared distances to the slots' borders, at most one step for a projection."""
        steps = sorted([(p * p, i, -1) for i, p in enumerate(place)] + [((1 - p) ** 2, i, 1) for i, p in enumerate(place)])
        out, heap = [np.zeros(self.bits, np.int64)], [(steps[0][0], (0,))]
        while heap and len(out) < n:
            cost, chosen = heapq.heappop(heap)
            if len({steps[k][1] for k in chosen}) == len(chosen):
                shift = np.zeros(self.bits, np.int64)
                for k in chosen:
                    shift[steps[k][1]] += steps[k][2]
                out.append(shift)
            last = chosen[-1]
            if last + 1 < len(steps):
                heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that can take part: neither null nor zero, all components finite."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("v is not null and vec_id is not null").filter(F.coalesce(fine, F.lit(False)))


class Chunk:
    """A part of the classes: vectors, member ids, and each table's bucket numbers in order."""

    def __init__(self, t: pa.Table, lsh: PStable):
        self.x, self.ids = matrix(t.column("v").combine_chunks()), t.column("ids").to_pylist()
        keys = lsh.keys(lsh.slots(self.x)[0])
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    def candidates(self, wanted: np.ndarray) -> np.ndarray:
        """Marks the vectors that any table's wanted buckets (tables by probes) hold, each once."""
        marked = np.zeros(len(self.x), bool)
        for t, w in enumerate(wanted):
            own, order = self.keys[:, t], self.order[:, t]
            lo, hi = np.searchsorted(own, w), np.searchsorted(own, w, side="right")
            for i, j in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                marked[order[i:j]] = True
        return marked

    def nearest(self, q: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest ids to one query among the rows given; only these are measured, and exactly."""
        squares = ((self.x[rows] - q) ** 2).sum(axis=1)
        if len(rows) > k:
            near = np.flatnonzero(squares <= np.partition(squares, k - 1)[k - 1] * (1 + 1e-12))  # roots may be equal where squares differ in the last place
            rows, squares = rows[near], squares[near]
        return sorted((d, m) for d, j in zip(np.sqrt(squares).tolist(), rows.tolist(), strict=True) for m in self.ids[j])[:k]


def search(vectors: DataFrame, k: int = 10, every: int = 100, tables: int = 4, bits: int = 6, probes: int = 130, spread: float = 1.47, chunk: int = 16_384, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows whose vec_id `every` divides.

    Equal vectors are one class that keeps its k + 1 smallest ids, enough for any of its members. Each distinct query
    visits, in every table, its own bucket and those that small steps of its slots reach, in estimated success order.
    Classes are dealt to chunks by hash, so that neither frequent vectors nor crowded buckets meet in one task, and
    queries to blocks; each block goes once to each chunk. A task marks what a query's buckets hold in its chunk, in all
    tables together, measures these vectors alone, each once, and answers with the k + 1 nearest. Queries that find fewer than k others, though
    there are more, are measured against all of every chunk. Rows whose dimension isn't the commonest take no part; ids
    that are null, and rows without usable vectors, neither; an empty table gives an empty result. The slot width is `spread` times the distance within which
    nine tenths of a bounded sample have k neighbours, so that close copies of some vectors don't narrow it for the others.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # one row
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == d).withColumn("vh", F.xxhash64("v"))
    least = F.row_number().over(Window.partitionBy("vh", "v").orderBy("vec_id"))
    classes = rows.withColumn("n", least).filter(F.col("n") <= k + 1).groupBy("vh", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.select(F.col("vh").alias("c"), "v", "ids"), "classes")
    sample = classes.filter(hash_share("c", max(2, SAMPLE) / n, 5)).select("v").toPandas()["v"]
    x = np.stack(sample) if len(sample) > 1 else np.ones((2, d))
    squares = (x * x).sum(axis=1)
    apart = squares[:, None] + squares[None] - 2 * x @ x.T
    np.fill_diagonal(apart, np.inf)
    tenth = np.partition(apart, min(k, len(x) - 1) - 1, axis=1)[:, min(k, len(x) - 1) - 1]
    width = spread * float(np.quantile(np.sqrt(np.maximum(0, tenth)), 0.9)) or 1.0
    lsh = PStable(d, width, tables, bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, places = lsh.slots(matrix(b.column("v")))
            keys = [np.stack([lsh.keys(s + np.stack(found)) if len(found := lsh.probes(p, probes)) == probes else np.resize(lsh.keys(s + np.stack(found)), probes) for s, p in zip(ss, ps, strict=True)]).astype("<u4").tobytes() for ss, ps in zip(slots, places, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(keys, pa.binary())], ["q", "v", "keys"])

    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", F.col("vh").alias("c"), "v")
    same = queries.groupBy("c", "v").agg(F.min("vec_id").alias("q"))
    asked, at = written(same.select("q", "v"), "queries")
    n_asked, n_classes = asked.count(), classes.count()
    asked = materialize(asked.repartition(max(8, n_asked // 2048), "q").mapInArrow(probe, "q long, v array<double>, keys binary"), "probes")
    discard(spark, at)

    def answer(whole: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"q": [], "vec_id": [], "score": []}
            if left.num_rows and right.num_rows:
                part = Chunk(right, lsh)
                q, asking = matrix(left.column("v").combine_chunks()), left.column("q").to_pylist()
                wanted = left.column("keys").to_pylist()
                every = np.arange(len(part.x))
                for name, v, w in zip(asking, q, wanted, strict=True):
                    rows = every if whole else np.flatnonzero(part.candidates(np.frombuffer(w, "<u4").reshape(tables, -1)))
                    for s, m in part.nearest(v, rows, k + 1) if len(rows) else ():
                        out["q"].append(name), out["vec_id"].append(m), out["score"].append(s)
            return pa.table({"q": pa.array(out["q"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

        return run

    def against_chunks(some: DataFrame, n_some: int, whole: bool) -> DataFrame:
        parts, blocks = max(-(-n_classes // chunk), min(16, n_classes // 512 + 1)), n_some // block + 1
        every_part, every_block = (F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (parts, blocks))
        left = some.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("part", every_part)
        right = classes.select("v", "ids", F.pmod(F.xxhash64("c", F.lit(9)), F.lit(parts)).cast("int").alias("part")).withColumn("block", every_block)
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(answer(whole), "q long, vec_id long, score double")

    near = materialize(against_chunks(asked, n_asked, False), "near")
    most = F.least(F.lit(k + 1).cast("long"), F.lit(n))  # a query finds itself too
    short = materialize(asked.join(near.groupBy("q").agg(F.count("*").alias("had")), "q", "left").filter(F.coalesce("had", F.lit(0)) < most).select("q", "v", "keys"), "short")
    if left := short.count():
        near = near.join(short.select("q").hint("merge"), "q", "left_anti").unionByName(against_chunks(short, left, True))
    first = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    best = near.withColumn("n", first).filter(F.col("n") <= k + 1).drop("n")
    members_of = queries.withColumnRenamed("vec_id", "query_id").distinct().join(same, ["c", "v"]).select("query_id", "q")
    hits = members_of.join(best, "q").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_probed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
