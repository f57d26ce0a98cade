"""Quality classification: labelled latent-semantic vectors vote, weighted by cosine similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import id_remainder, labelled_rows, map_texts, table

PAIRS, WORDS = 1216, 800
TERMS = PAIRS + WORDS + 32
DIMENSIONS = 48
#: Labelled documents that vote, at most about so many; chosen by a hash of the id, so the broadcast stays near 1 MB.
SAMPLE = 4000
NEIGHBOURS = 15
THRESHOLD = 0.7


def terms(text: str) -> np.ndarray:
    """Damped counts of a text's terms: byte pairs and words, hashed into buckets, and two marks of repetition: how often a word follows itself, and a pair of words comes again."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 1:
        pairs = np.bincount((b[:-1] * np.uint32(257) + b[1:] * np.uint32(7919)) % np.uint32(PAIRS), minlength=PAIRS)
        out[:PAIRS] = np.sqrt(pairs / len(b))
    words = raw.split()
    if words:
        counts = Counter(words)
        at = np.fromiter(map(crc32, counts), np.uint32, len(counts)) % np.uint32(WORDS)
        found = np.bincount(at, np.fromiter(counts.values(), float, len(counts)), WORDS)
        out[PAIRS : PAIRS + WORDS] = 0.5 * np.sqrt(found / len(words))
        runs = sum(map(bytes.__eq__, words[:-1], words[1:])) / len(words)
        spread = 1 - len(set(zip(words[:-1], words[1:], strict=True))) / max(1, len(words) - 1)
        for k, x in enumerate((runs, spread)):
            out[PAIRS + WORDS + 16 * k + min(15, int(x * 16))] = 0.5
    return out


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Marks each row's k largest similarities; of equal ones at the last place, those of the first voters."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
    marked, equal = near > least, near == least
    free = k - marked.sum(axis=1)
    for i in np.flatnonzero(equal.sum(axis=1) > free):
        equal[i, np.flatnonzero(equal[i])[free[i] :]] = False
    return marked | equal


class Votes:
    """Term weights, the projection to latent dimensions, and the voters' unit vectors and labels. Fitting works in place on the rows, some 30 MB."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        seen = (rows > 0).sum(axis=0)
        self.weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 0.3
        x = rows
        x *= self.weight
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        rng = np.random.default_rng(1)
        q = x @ rng.standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
        for _ in range(3):
            q = x @ (x.T @ np.linalg.qr(q)[0])
        q = np.linalg.qr(q)[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32)
        self.voters, self.labels = self.unit(x @ self.axes), labels.astype(np.float32)
        self.prior = float(labels.mean())

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def score(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            x = self.unit(np.array([terms(t) for t in texts[at : at + block]]) * self.weight)
            x = self.unit(x @ self.axes)
            near = np.round(x @ self.voters.T, 5)
            marked = nearest(near, k)  # k in each row
            power = np.maximum(1e-6, near[marked].astype(float)).reshape(-1, k) ** 8
            votes = (power * self.labels[np.nonzero(marked)[1]].reshape(-1, k)).sum(axis=1) / power.sum(axis=1)
            out[at : at + block] = np.where(x.any(axis=1), votes, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Votes | None:
    """Learns from labels (doc_id, quality) of a bounded sample of docs; only damped term counts reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    _, rows = labelled_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), known, bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [terms(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "terms"])

    got = map_texts(rows.select("doc_id", "text", "quality"), count, "doc_id long, quality int, terms binary").toPandas().sort_values(["doc_id", "quality"])
    if not len(got):
        return None
    rows = np.empty((len(got), TERMS), np.float32)
    for k, t in enumerate(got["terms"]):
        rows[k] = np.frombuffer(t, np.float16)
    labels_of = got["quality"].to_numpy()
    del got
    return Votes(rows, labels_of)


def score(docs: DataFrame, model: Votes | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then score, from 0 to 1, for each row from the text alone. Texts without a known term (null, empty, a single white-space character) meet all voters alike and get the share of good ones; if nothing could be learned, all get 1. Texts at right angles to all voters get the plain vote of the first ones. Texts of any length count whole; repeated rows score alike, other columns don't matter, and an empty table gives an empty result. Similarities are rounded, so that ties fall alike in any batch; voters equally near at the last place vote in the order of their ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            out = np.where([not t for t in texts], m.prior, m.score(texts)) if m else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, "score"])

    rows = docs.select(*keep, *[c for c in ("text",) if c not in keep]).withColumn("text", F.col("text").cast("string"))
    return map_texts(rows, run, T.StructType([*rows.select(*keep).schema.fields, T.StructField("score", T.DoubleType())]))


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
