"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts, about; Spark's own bound is 64 MB, which each task holds several times over.
BATCH_BYTES = 8 << 20
#: A key with more than one in HOT of all rows is hot, so there are at most HOT of them.
HOT = 200
_FINE = 10**12
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary folder does for a local master; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch folders of this process; to be called when results have been written elsewhere."""
    for path in list(_made):
        discard(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors."""
    return written(df, name)[0]


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """rows.mapInArrow in batches bounded by bytes as well as rows, so that a task's memory doesn't follow the texts' lengths.

    All operators over texts come here and set the same bound, so it doesn't matter which of them a session plans first.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with per_key, which has one row for each key and n, the key's rows among `total`.

    Hot keys, at most HOT of them by their definition, are broadcast, so their rows stay where they are; the others meet
    in a shuffle, where no key brings more than one in HOT of all rows to a task. n is dropped.
    """
    hot = per_key.filter(F.col("n") * HOT > total).drop("n")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").hint("merge").join(per_key.drop("n"), keys, how)
    return cold.unionByName(rows.join(F.broadcast(hot), keys), allowMissingColumns=False)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_share(key: str, share: float, seed: int) -> Column:
    """Whether a hash of the key falls into the share, which may be very small."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_FINE)) < int(_FINE * min(1.0, share))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About `bound` rows chosen by a hash of the key, so that reruns choose the same; all rows if there are fewer."""
    n = df.count()
    return df if n <= bound else df.filter(hash_share(key, bound / n, seed))


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """Distinct labels (doc_id, label) of about `bound` ids at most, and the rows of docs (doc_id, text) that have them.

    A frequent id may bring any number of rows; where all together are more than a quarter above `bound`, about `bound`
    are chosen by a hash of id and text, of repeated rows the first, and twice `bound` is never exceeded.
    """
    chosen = bounded_sample(labels, "doc_id", bound).distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id")
    n = rows.count()
    if n > bound + bound // 4:
        rows = rows.withColumn("_h", F.xxhash64("doc_id", "text", F.lit(seed))).filter(hash_share("_h", bound / n, seed)).dropDuplicates(["_h"]).drop("_h").limit(2 * bound)
    return chosen, rows
