"""From documents to packed sequences: language, quality, near-duplicates, source mix, packing. Counted as part of llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import langid, mixing, packing, quality_votes, simhash
from latticework.llm.common import id_remainder, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of texts that the packing encodes at once: by then an executor's heap is full and its workers hold what near-dedup left there, so a whole batch may be too much.
SLICE_BYTES = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the codes know for sure; und and ambiguous ones go. lang becomes the prediction.

    Null, empty and blank texts and texts without a letter are und and go. Each row is judged by its whole text alone, of
    any length, so repeated rows and ties fare alike; null ids and sources change nothing. An empty table stays empty.
    """
    model = langid.fit(docs.filter(id_remainder("doc_id", 5) != 0))
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the votes call good.

    Texts without a known term (null, empty, blank) get the share of good labels and go or stay by it; where no label
    meets a document, all stay. Texts of any length count whole; an empty table gives an empty result.
    Each row is judged by its whole text alone, so repeated rows and ties fare alike.
    """
    model = quality_votes.fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 4) != 2))
    return quality_votes.score(docs, model, keep=COLUMNS).filter(F.col("score") >= quality_votes.THRESHOLD).select(*COLUMNS)


def row_hash(*seed: Column) -> Column:
    """A hash of the row's values, nulls told apart."""
    return F.xxhash64(*seed, *[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of the smallest id, null last, then of the smallest hash of the row.

    Groups join texts whose sets of five-word shingles have a similarity of 0.8 or more, whatever their ids. Similarities
    are estimated by sketches, from 0.77 on, so texts between about 0.74 and 0.8 may be joined too, and few above 0.8 may
    stay apart. Null, empty and blank texts are one group, of which one row stays. Texts of any length count whole.
    """
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", row_hash().alias("row")).alias("key")  # a null id in a struct is equal to another, and comes last
    keyed = docs.select(*COLUMNS, key)
    groups = materialize(simhash.similar_documents(keyed), "groups")
    kept = groups.groupBy("component").agg(F.min("key").alias("key")).select("key")
    return simhash.rows_of(keyed, kept, simhash.hot_keys(groups, groups.count())).select(*COLUMNS)  # equal rows share a key


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it leaves out go.

    Rows that share an id are mixed each by itself; equal rows come once for each copy that is taken of any of them. Null
    and blank texts have no word, so none is taken and they go. Null sources are one source. Lengths are counted whole.
    """
    keyed = docs.select(*COLUMNS, row_hash().alias("key"), row_hash(F.lit(7)).alias("also"))  # rows that share the one hash differ in the other, so none is lost
    taken = mixing.mix(keyed.select(F.col("key").alias("doc_id"), "text", "source")).groupBy("doc_id").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = materialize(taken.select(F.col("doc_id").alias("key"), "copies"), "taken")  # grows with the documents: never broadcast, at any size
    one = keyed.join(taken.hint("merge"), "key").dropDuplicates(["key", "also"])
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies too, with their sequences and offsets. Null and empty texts hold the end id alone; very long ones make several pieces; rows that share an id are packed one by one."""
    return packing.pack(docs, slice_bytes=SLICE_BYTES)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Its models, hashes of shingles and token ids can't be told in SQL; tests/llm/test_pipeline.py holds each stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
