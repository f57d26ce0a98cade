"""Line dedup: levelled sorted runs of line hashes, compacted periodically; each batch merge-anti-joins them and adds its own."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import discard, map_texts, materialize, scratch_path, table

#: ASCII white space, which a line's key has at neither end.
SPACE = b" \t\n\v\f\r"
#: Frequent keys that tasks may hold at once, 16 bytes each; more of them are joined with the texts that hold them.
HELD = 100_000
KEY = ["a", "b"]


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """A key's 128-bit hash as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    low, high = h & (1 << 64) - 1, h >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def document_lines(docs: DataFrame, least: int, batches: int) -> DataFrame:
    """batch, a, b: each distinct key of at least `least` code points of each row, and the row's batch, by a hash of id and text."""

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            found, of = [], []
            for k, text in zip(r.column("batch").to_pylist(), r.column("text").to_pylist(), strict=True):
                own = {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")}
                hashes = [key_hash(x) for x in own if long_enough(x, least)]
                found += hashes
                of += [k] * len(hashes)
            both = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["batch", *KEY])

    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    return map_texts(docs.select(batch, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), keys, "batch int, a long, b long")


class LineRuns:
    """Runs (a, b, n) of line hashes and the documents that hold them, on levels of `fanout` runs each.

    A run is a table bucketed and sorted by its key, one way for all runs, so batches are joined with runs and runs with
    each other bucket by bucket, without a shuffle. A key is settled once a run counts `enough` documents for it: it needs
    no more counts, and later batches leave it out by an anti join. As soon as a level holds `fanout` runs they become
    one of the next level, counts added up; a key is thus written once a level, and each batch meets at most `fanout` - 1
    runs of each. There are as many buckets as a shuffle has partitions, which follows the data's size where it is set.
    Runs lie in the shared folder and are only added whole, so a lost executor costs its own tasks.
    """

    def __init__(self, spark: SparkSession, enough: int, buckets: int = 0, fanout: int = 3):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def write(self, keys: DataFrame, *partitions: str) -> str:
        """A new run of rows that are dealt by their key already, or are dealt here."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "run")
        out = keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name])
        (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        discard(self.spark, self.paths.pop(name))

    def summed(self, names: list[str]) -> DataFrame:
        """One row a key. The filter, true of all rows, turns the scans' column batches to rows: Spark's union keeps the buckets of rows together, but not those of column batches."""
        return reduce(DataFrame.unionByName, [self.spark.table(x).filter("n > 0") for x in names]).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Takes in a batch (a, b, n), one row a key; keys settled in a run are left out of the batch's own run."""
        for name in [x for level in self.levels for x in level]:
            settled = self.spark.table(name).filter(F.col("n") >= self.enough).select(*KEY)
            batch = batch.hint("merge").join(settled.hint("merge"), KEY, "left_anti")
        self.push(0, self.write(batch))

    def push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.push(level + 1, self.write(self.summed(old)))
            for name in old:
                self.drop(name)

    def frequent(self) -> DataFrame:
        """a, b of the keys that enough documents hold, by all runs together."""
        names = [x for level in self.levels for x in level]
        return self.summed(names).filter(F.col("n") >= self.enough).select(*KEY)

    def clear(self) -> None:
        for name in list(self.paths):
            self.drop(name)


def frequent_lines(docs: DataFrame, least: int = 1, enough: int = 10, batches: int = 4) -> DataFrame:
    """a, b of the line keys of at least `least` code points that at least `enough` rows of docs hold, found batch by batch."""
    spark = docs.sparkSession
    runs = LineRuns(spark, enough)
    counted = document_lines(docs, least, batches).groupBy("batch", *KEY).agg(F.count("*").alias("n"))
    incoming = runs.write(counted.repartition(runs.buckets, *KEY), "batch")
    for k in range(batches):
        runs.add(spark.table(incoming).filter(F.col("batch") == k).select(*KEY, "n"))
    runs.drop(incoming)
    out = materialize(runs.frequent(), "frequent")
    runs.clear()
    return out


def cleaned(docs: DataFrame, gone: np.ndarray | None, keep: tuple[str, ...], with_text: bool) -> DataFrame:
    """The columns `keep`, n_lines, n_dropped, kept_sha256 and, if wanted, kept; gone are the hashes of lines to drop, or each row brings its own as `hits`."""
    shipped = docs.sparkSession.sparkContext.broadcast(None if gone is None else set(map(tuple, gone.tolist())))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for r in rows:
            n_lines, n_dropped, digests, kept = [], [], [], []
            own = r.column("hits").to_pylist() if held is None else [held] * r.num_rows
            for text, drop in zip(r.column("text").to_pylist(), own, strict=True):
                if held is None:
                    drop = {(x["a"], x["b"]) for x in drop or ()}
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                left = [x for x in lines if key_hash(line_key(x)) not in drop] if drop else lines
                whole = b"\n".join(left)
                n_lines.append(len(lines)), n_dropped.append(len(lines) - len(left)), digests.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept.append(whole.decode("utf-8", "surrogatepass"))
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*[r.column(c) for c in keep], *made], [*keep, "n_lines", "n_dropped", "kept_sha256", *(["kept"] if with_text else [])])

    made = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.StringType())] if with_text else [])]
    rows = docs.select(*keep, *[c for c in ("text", "hits") if c in docs.columns and c not in keep])
    return map_texts(rows, run, T.StructType([*rows.select(*keep).schema.fields, *made]))


def with_hits(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """docs with `hits`, the frequent hashes that the row's text holds. Texts are named by a 128-bit hash and looked up once each, so copies, however many, send one set of lines; only hashes are shuffled for it."""
    named = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            found: list[tuple[int, int, int, int]] = []
            for one, two, text in zip(r.column("t1").to_pylist(), r.column("t2").to_pylist(), r.column("text").to_pylist(), strict=True):
                found += [(one, two, *key_hash(x)) for x in {line_key(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")}]
            both = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(4)], ["t1", "t2", *KEY])

    lines = map_texts(named.select("t1", "t2", F.coalesce("text", F.lit("")).alias("text")), keys, "t1 long, t2 long, a long, b long").distinct()
    hits = lines.join(frequent, KEY).groupBy("t1", "t2").agg(F.collect_list(F.struct(*KEY)).alias("hits"))
    return named.join(hits, ["t1", "t2"], "left").drop("t1", "t2")


def drop_frequent_lines(docs: DataFrame, least: int = 1, enough: int = 10, batches: int = 4, keep: tuple[str, ...] = ("doc_id",), with_text: bool = True, held: int = HELD) -> DataFrame:
    """The columns `keep` of each row, n_lines, n_dropped, kept_sha256 and kept, the text without its frequent lines.

    Texts are split at \\n. A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at
    least `least` code points that at least `enough` rows hold lose all their lines everywhere. Every row is a document
    of its own, rows that repeat an id or each other too; a null or empty text is one empty line, and blank lines have
    an empty key, which `least` 1 leaves alone. Keys are told apart by 128-bit hashes. Of each row only hashes of its
    distinct lines are shuffled; texts of any length are taken whole and stay where they are, unless more than `held`
    keys are frequent: then texts meet their own frequent keys in a join. Other columns, whatever their names, don't
    matter, and an empty table gives an empty result.
    """
    rows = docs.select(*[F.col(c) for c in keep], *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    frequent = frequent_lines(docs, least, enough, batches)
    if frequent.count() > held:
        return cleaned(with_hits(rows, frequent), None, keep, with_text)
    gone = frequent.toPandas()  # at most `held` rows
    return cleaned(rows, gone.to_numpy(np.int64).reshape(-1, 2), keep, with_text)


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_frequent_lines(table(spark, sf_dir, "documents"), with_text=False)


_KEYS = r"trim(translate(line,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text,''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT r, pos, line, {_KEYS} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
  string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)) AS kept FROM k GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept,'')) AS kept_sha256 FROM d JOIN s USING (r)"""
