"""Trained ensembles and calibrated machines over `embeddings`: pairs of neighbouring labels, eight slices of the vector as measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators import svm
from latticework.operators import training as T
from latticework.session import table

#: The pairs of neighbouring groups that are told apart.
PAIRS = ((0, 1), (1, 2), (2, 3))
SLICES = 8
KEYS = ["g0", "g1", "member"]


def paired(spark, d, learning: bool) -> DataFrame:
    """Vectors of each pair's labels as g0, g1, unit, label (1 for g1) and features; every fifth is to learn from."""
    fits = F.coalesce(F.pmod("vec_id", F.lit(5)) == 0, F.lit(False))
    e = table(spark, d, "embeddings").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fits if learning else ~fits)
    pairs = spark.createDataFrame(PAIRS, "g0 int, g1 int")
    both = e.join(F.broadcast(pairs), F.col("label").isin(F.col("g0"), F.col("g1")))
    return both.select("g0", "g1", F.col("vec_id").alias("unit"), (F.col("label") == F.col("g1")).cast("int").alias("label"), F.col("embedding").alias("features"))


def cohort(spark, d, learning: bool) -> DataFrame:
    """The same by slices, each a member's features."""
    width = F.ceil(F.size("features") / SLICES).cast("int")
    member = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("member")
    own = paired(spark, d, learning).select("*", member)
    return own.withColumn("features", F.slice("features", F.col("member") * width + 1, width))


def members(spark, d) -> DataFrame:
    return T.train_members(cohort(spark, d, True), KEYS)


def member_performance(spark, d) -> DataFrame:
    """Each member's confusion and accuracy by nested cross-validation, and its place in the ensemble."""
    m = members(spark, d).select(*KEYS, "n", "tn", "fp", "fn", "tp", "accuracy")
    return m.join(T.member_order(m, ["g0", "g1"], KEYS), KEYS).withColumn("accuracy", r9(F.col("accuracy")))


def ensemble_posteriors(spark, d) -> DataFrame:
    """Evidence of trained members for each vector that none has learned from."""
    trained = members(spark, d)
    out = T.ensemble(T.predict_members(cohort(spark, d, False), trained, KEYS), trained, ["g0", "g1"], KEYS)
    return out.withColumn("posterior", r9(F.col("posterior")))


def svm_query(spark, d) -> DataFrame:
    """Margins, posteriors and votes of labels 0 and 1 for vectors not learned from."""
    known, rest = (paired(spark, d, learning).filter("g0 = 0 and g1 = 1") for learning in (True, False))
    return svm.svm_posteriors(known, rest.drop("label")).select("unit", r9(F.col("margin")).alias("margin"), r9(F.col("p")).alias("p"), "vote")


QUERIES = {"member_performance": member_performance, "ensemble_posteriors": ensemble_posteriors, "svm_posteriors": svm_query}
ORACLE: dict[str, str] = {}
