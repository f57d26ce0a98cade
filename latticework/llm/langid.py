"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import bounded_sample, id_remainder, map_texts, table

UNKNOWN = "und"
BUCKETS = 1 << 14
#: Labelled rows to learn from, at most about so many; chosen by a hash of the id.
SAMPLE = 20_000


def ngrams(text: str) -> np.ndarray:
    """Buckets of the lower-cased text's overlapping three-byte grams."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % np.uint32(BUCKETS)


def codewords(n: int, longest: int = 63, seed: int = 3) -> np.ndarray:
    """n rows of +1 and -1: all ways to split up to 7 languages in two, or else random splits, chosen far apart."""
    if n <= 7:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns or [(1,) * n]).T
    rng = np.random.default_rng(seed)
    best = max((np.where(rng.random((n, longest)) < 0.5, -1, 1) for _ in range(200)), key=lambda c: -(np.abs(c @ c.T - longest * np.eye(n)).max()))
    return best[:, np.abs(best.sum(axis=0)) < n]


class CodeModel:
    """Languages, their codewords, a weight vector for each bit and each bit's weight in the decoding."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.codes = codewords(len(self.languages))
        share = np.array([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in self.languages])
        self.weights = np.empty((BUCKETS, self.codes.shape[1]), np.float32)
        for b, code in enumerate(self.codes.T):
            ones, others = share[code > 0], share[code < 0]
            self.weights[:, b] = np.log(ones.mean(axis=0)) - np.log(others.mean(axis=0)) if len(others) else 1.0
        self.bit_weights = np.ones(self.codes.shape[1])

    def margins(self, text: str) -> np.ndarray:
        """Each bit's mean log odds over the text's grams, stronger for longer texts."""
        g, total = ngrams(text), np.zeros(self.weights.shape[1])
        for at in range(0, len(g), 65_536):
            total += self.weights[g[at : at + 65_536]].sum(axis=0, dtype=np.float64)
        return total / len(g) * min(len(g), 64) / 4

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """The chance of each language: a soft minimum over its codeword's weighted logistic loss."""
        loss = (np.logaddexp(0, -self.codes * margins) * self.bit_weights).sum(axis=1)
        e = np.exp(loss.min() - loss)
        return e / e.sum()


def fit(docs: DataFrame, bound: int = SAMPLE) -> CodeModel | None:
    """Learns from rows of docs with text and lang, on a bounded sample: gram counts per language, added up on Spark, of four fifths of it, then each bit's weight, which is its accuracy on the rest.

    Rows are dealt by a hash of the text, so equal texts are on one side. Where no row is left over, all bits weigh the same.
    """
    rows = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null"), "doc_id", bound)

    beside = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(5)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                sums[x] = sums.get(x, 0) + np.bincount(ngrams(t), minlength=BUCKETS)
        for x, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    summed = map_texts(rows.filter(~beside).select("text", "lang"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in summed.toPandas().itertuples():  # languages times buckets at most
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    if not counts:
        return None
    model = CodeModel(counts)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            right = [(m.codes[m.languages.index(x)] * m.margins(t) > 0).astype(int).tolist() for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.list_(pa.int32()))], ["right"])

    hits = map_texts(rows.filter(beside & F.col("lang").isin(model.languages)).select("text", "lang"), tested, "right array<int>")
    got = hits.agg(F.count("*").alias("n"), *[F.sum(F.get("right", F.lit(i))).alias(f"b{i}") for i in range(model.codes.shape[1])]).collect()[0]
    if not got["n"]:
        return model
    accuracy = np.clip([(got[f"b{i}"] + 1) / (got["n"] + 2) for i in range(model.codes.shape[1])], 0.5, 0.999)
    model.bit_weights = np.log(accuracy / (1 - accuracy)) + 1e-3
    model.bit_weights /= model.bit_weights.mean()
    return model


def predict(docs: DataFrame, model: CodeModel | None, ambiguous_below: float = 0.2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then lang_pred, score, ambiguous for each row; the text is all that a prediction sees.

    Null texts and texts without a letter are `und` with score 0 and ambiguous; so is every text if nothing could be
    learned. ambiguous: the two nearest codewords' chances differ by less than `ambiguous_below`. Codewords equally near
    tie in favour of the language that sorts first. Texts of any length count whole; equal texts get equal results.
    Other columns don't matter, and an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            names, scores, doubts = [], [], []
            for t in b.column("text").to_pylist():
                if m is None or not t or not any(map(str.isalpha, t)):
                    name, score, doubt = UNKNOWN, 0.0, True
                else:
                    p = m.decode(m.margins(t))
                    top = np.sort(p)[::-1]
                    name, score, doubt = m.languages[int(p.argmax())], float(top[0]), bool(len(top) > 1 and top[0] - top[1] < ambiguous_below)
                names.append(name), scores.append(score), doubts.append(doubt)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    rows = docs.select(*keep, *[c for c in ("text",) if c not in keep]).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return map_texts(rows, run, schema)


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(id_remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
