"""Hard-negative mining: inner products searched through length buckets of sorted coordinate lists, pruned by focus coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import hash_share, materialize, table

#: Vectors by which anchors get a first bound on their positives' scores, at most about so many.
SAMPLE = 2000
#: Values of components beyond this take no part: their products need not fit a long.
LARGEST = 1 << 24
#: Each length bucket's longest vector is at most so much longer than its shortest.
RATIO = 1.25
#: Focus coordinates whose ranges are intersected; a range with more than this share of a list prunes nothing.
FOCUS, WORTH = 6, 0.7
ROW = ["d", "bucket", "part"]


def usable(df: DataFrame, relabel: Callable[[Column, Column], Column] | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, x (floor of scale * component), d and bucket, the logarithm of x's length, of the rows that take part."""
    v = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")))
    wrong = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST / scale))
    rows = df.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.coalesce(wrong, F.lit(True)) & (F.size("embedding") > 0))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = rows.select(vec_id.alias("vec_id"), (relabel(vec_id, label) if relabel else label).alias("label"), F.transform(v, lambda c: c.cast("int")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return rows.select("*", F.size("x").alias("d"), F.when(square > 0, F.floor(F.log(square) / (2 * math.log(RATIO)))).otherwise(-1).cast("int").alias("bucket"))


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    return (flat.flatten() if isinstance(flat, pa.ListArray) else flat).to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they can't round, else in longs."""
    if not len(x):
        return np.zeros((len(q), 0), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


class Bucket:
    """Vectors of like length in order of their ids, repeated rows once, and for each coordinate of the unit vectors its sorted list."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        keep = np.unique(np.column_stack([ids, labels, x]), axis=0, return_index=True)[1]
        self.ids, self.labels, self.x = ids[keep], labels[keep], x[keep]
        length = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        self.unit = self.x / np.maximum(length, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def ranges(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query whether any vector can reach its least score, and the values that each coordinate of such a vector may have.

        A unit vector within the angle t of the query lies within t of the query's own angle a to each axis: its
        coordinate is between cos(a + t) and cos(a - t).
        """
        size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        reach = size * self.longest
        cosine = np.divide(least, reach, out=np.where(least > 0, 2.0, -1.0), where=reach > 0)
        possible = cosine <= 1 + 1e-9
        t = np.arccos(np.clip(cosine - 1e-9, -1, 1))[:, None]
        a = np.arccos(np.clip(q / np.maximum(size, 1e-300)[:, None], -1, 1))
        return possible, np.cos(np.minimum(math.pi, a + t)) - 1e-9, np.cos(np.maximum(0, a - t)) + 1e-9

    def candidates(self, q: np.ndarray, least: np.ndarray) -> list[np.ndarray | None]:
        """For each query the rows that can reach its least score, in order, or None where the lists rule out too few to matter."""
        possible, low, high = self.ranges(q, least)
        first, last = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
        for f in range(q.shape[1]):
            first[:, f] = np.searchsorted(self.sorted[:, f], low[:, f], "left")
            last[:, f] = np.searchsorted(self.sorted[:, f], high[:, f], "right")
        count = last - first
        out: list[np.ndarray | None] = []
        for i in range(len(q)):
            if not possible[i]:
                out.append(np.zeros(0, np.int64))
                continue
            focus = np.argsort(count[i], kind="stable")[:FOCUS]
            if count[i, focus[0]] > WORTH * len(self.ids):
                out.append(None)
                continue
            f = focus[0]
            rows = self.order[first[i, f] : last[i, f], f]
            for f in focus[1:]:
                if count[i, f] <= WORTH * len(self.ids):
                    value = self.unit[rows, f]
                    rows = rows[(value >= low[i, f]) & (value <= high[i, f])]
            out.append(np.sort(rows))
        return out

    def scored(self, q: np.ndarray, least: np.ndarray, step: int = 128):
        """Each query's number, its candidates and their exact scores, in order of ids."""
        for at in range(0, len(q), step):
            part = q[at : at + step]
            found = self.candidates(part, least[at : at + step])
            whole = [i for i, rows in enumerate(found) if rows is None]
            dense = dict(zip(whole, products(part[whole], self.x), strict=True)) if whole else {}
            for i, rows in enumerate(found):
                if rows is None:
                    yield at + i, np.arange(len(self.ids)), dense[i]
                elif len(rows):
                    yield at + i, rows, products(part[i : i + 1], self.x[rows])[0]


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id, best first."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def bounds_by_sample(rows: DataFrame, anchors: DataFrame, k: int, bound: int, n: int) -> DataFrame:
    """anchors with `least`, the k-th best score among a bounded sample's rows of the anchor's label: no positive of it scores less. Null where the sample has too few."""
    some = rows.filter(hash_share("h", bound / max(1, n), 5)).limit(2 * bound).select("vec_id", "label", "x", "d").toPandas()
    groups = {key: (g["vec_id"].to_numpy(np.int64), np.stack(g["x"]).astype(np.int64)) for key, g in some.groupby(["d", "label"])}
    shipped = rows.sparkSession.sparkContext.broadcast(groups)
    fields = ["anchor_id", "h", "label", "d", "x"]

    def run(batches):
        for b in batches:
            least = []
            for vec_id, label, d, x in zip(b.column("anchor_id").to_pylist(), b.column("label").to_pylist(), b.column("d").to_pylist(), b.column("x"), strict=True):
                ids, others = shipped.value.get((d, label), (np.zeros(0, np.int64), None))
                own = ids != vec_id
                scores = products(x.values.to_numpy(zero_copy_only=False).astype(np.int64)[None], others[own])[0] if own.sum() >= k else None
                least.append(None if scores is None else int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            yield pa.RecordBatch.from_arrays([*[b.column(f) for f in fields], pa.array(least, pa.int64())], [*fields, "least"])

    return anchors.select(*fields).mapInArrow(run, "anchor_id long, h long, label long, d int, x array<int>, least long")


def against_buckets(rows: DataFrame, asked: DataFrame, n_asked: int, sizes: DataFrame, answer: Callable, schema: str, block: int) -> DataFrame:
    """`answer` of each block of asked rows and each part of a length bucket that can hold scores of `least` or more; other buckets aren't visited."""
    blocks = n_asked // block + 1
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    can = F.col("least").isNull() | (F.col("least") <= length * F.col("longest") * (1 + 1e-9))
    left = asked.join(F.broadcast(sizes), "d").filter(can).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("longest", "parts")
    left = left.withColumn("block", F.pmod(F.xxhash64("anchor_id", "h"), F.lit(blocks)).cast("int"))
    right = rows.join(F.broadcast(sizes.drop("longest")), ["d", "bucket"]).withColumn("part", F.pmod(F.xxhash64("h", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    right = right.select(*ROW, "vec_id", "label", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy(*ROW, "block").cogroup(right.groupBy(*ROW, "block")).applyInArrow(answer, schema)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: Callable[[Column, Column], Column] | None = None, chunk: int = 16_384, block: int = 16_384, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives
    the best rows of other labels whose score is from low to high percent of the positive's.

    Components become floor(256 * component); scores are exact integer inner products. Anchors are the rows whose vec_id
    `every` divides, positives their best other rows of the same label; higher scores first, ties by smaller vec_id.
    Rows are put in buckets of like length, buckets of many rows in parts by a hash, so that neither a frequent vector
    nor a frequent label meets in one task; anchors are dealt in blocks, and each block goes to the parts whose longest
    vector can reach its bound. There, every coordinate has a sorted list; the values feasible for an anchor's most
    telling coordinates give candidates, which are intersected and then scored exactly. Nothing is approximate: first
    bounds come from a bounded sample, which can only make searches shorter, and positives bound their negatives.

    Rows with a null id, label or vector, an empty vector, or a component that is null, not finite or above 65,536 in
    size take no part; vectors meet those of their own dimension only. Repeated rows count once, and rows that share
    an id are never each other's positives or negatives. Zero vectors score 0. Other columns don't matter, and an empty
    table gives an empty result.
    """
    rows = materialize(usable(vectors, relabel).withColumn("h", F.xxhash64("vec_id", "label", "x")), "codes")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    found = rows.groupBy("d", "bucket").agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect()  # a row for each dimension and length bucket
    n = sum(r["n"] for r in found)
    sizes = rows.sparkSession.createDataFrame([(r["d"], r["bucket"], r["longest"], max(-(-r["n"] // chunk), min(16, r["n"] // 512 + 1))) for r in found], "d int, bucket int, longest double, parts int")
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "h", "label", "d", "x").dropDuplicates(["anchor_id", "h"])
    asked = materialize(bounds_by_sample(rows, anchors, positives, sample, n), "anchors")
    n_asked = asked.count()

    def part_of(right: pa.Table) -> Bucket:
        return Bucket(right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"], right.num_rows))

    def best_same(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            part, q = part_of(right), matrix(left["x"], left.num_rows)
            own, h, label = (left[c].to_numpy() for c in ("anchor_id", "h", "label"))
            least = left["least"].fill_null(-(1 << 62)).to_numpy().astype(float)
            for i, at, scores in part.scored(q, least):
                fits = (part.labels[at] == label[i]) & (part.ids[at] != own[i])
                at, scores = at[fits], scores[fits]
                top = first_by_score(scores, part.ids[at], positives)
                for column, values in zip(out, (np.full(len(top), own[i]), np.full(len(top), h[i]), part.ids[at[top]], scores[top]), strict=True):
                    column.append(values)
        return pa.table({name: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for name, c in zip(("anchor_id", "h", "id", "score"), out, strict=True)})

    near = against_buckets(rows, asked, n_asked, sizes, best_same, "anchor_id long, h long, id long, score long", block)
    first = F.row_number().over(Window.partitionBy("anchor_id", "h").orderBy(F.desc("score"), "id"))
    best = near.withColumn("nth", first).filter(F.col("nth") <= positives)
    of = best.groupBy("anchor_id", "h").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("p"))  # at most `positives` each
    fields = F.transform("p", lambda p: p["id"]).alias("positive_ids"), F.transform("p", lambda p: p["score"]).alias("positive_scores")
    bounded = asked.drop("least").join(of, ["anchor_id", "h"]).select("anchor_id", "h", "label", "d", "x", *fields)
    lowest = F.array_min(F.filter("positive_scores", lambda s: s >= 0))
    mining = materialize(bounded.withColumn("least", F.ceil(lowest * low / 100)).filter("least is not null"), "positives")

    def best_other(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            part, q = part_of(right), matrix(left["x"], left.num_rows)
            own, h, label = (left[c].to_numpy() for c in ("anchor_id", "h", "label"))
            ids, tops = left["positive_ids"].to_pylist(), left["positive_scores"].to_pylist()
            for i, at, scores in part.scored(q, left["least"].to_numpy().astype(float)):
                fits = (part.labels[at] != label[i]) & (part.ids[at] != own[i]) & (100 * scores <= high * tops[i][0])
                at, scores = at[fits], scores[fits]
                order = np.lexsort((part.ids[at], -scores))
                at, scores = at[order], scores[order]
                for positive, p in zip(ids[i], tops[i], strict=True):
                    fall = np.searchsorted(-100 * scores, -high * p, "left")
                    top = slice(fall, min(fall + negatives, int(np.searchsorted(-100 * scores, -low * p, "right"))))
                    count = max(0, top.stop - top.start)
                    for column, values in zip(out, (np.full(count, own[i]), np.full(count, h[i]), np.full(count, positive), np.full(count, p), part.ids[at[top]], scores[top]), strict=True):
                        column.append(values)
        names = ("anchor_id", "h", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({name: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for name, c in zip(names, out, strict=True)})

    some = against_buckets(rows, mining, n_asked, sizes, best_other, "anchor_id long, h long, positive_id long, positive_score long, negative_id long, negative_score long", block)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "h", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), relabel=lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256*CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label=b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id%50=0 AND a.vec_id<>b.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same) WHERE n<=5),
n AS (SELECT p.a, p.b, p.score, s.b AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a=s.a AND NOT s.same AND 50*p.score<=100*s.score AND 100*s.score<=95*p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INT) AS rank, negative_id, score AS positive_score, negative_score FROM n WHERE rank<=3"""
