"""Ensemble evidence, error-correcting votes, confusion shares, feature vectors and MLlib classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Keys = Sequence[str]
#: Rows are classes 0 to 2, columns the classifiers 0 against 1 and 1 against 2.
CODES = ((1, 0), (-1, 1), (0, -1))


def bayes(evidence: DataFrame, keys: Keys, order: str, cls: str = "cls", p: str = "p") -> DataFrame:
    """Adds posterior: the running product of p over `order`, normalised over classes at each step."""
    keys = list(keys)
    log = F.sum(F.log(p)).over(Window.partitionBy(*keys, cls).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    step = Window.partitionBy(*keys, order)
    e = evidence.withColumn("_l", log)
    e = e.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(step)))
    return e.withColumn("posterior", F.col("_e") / F.sum("_e").over(step)).drop("_l", "_e")


def mean_posterior(steps: DataFrame, keys: Keys, cls: str = "cls") -> DataFrame:
    return steps.groupBy(*keys, cls).agg(F.avg("posterior").alias("prob"))


def decode_votes(df: DataFrame, s1: str = "s1", s2: str = "s2") -> DataFrame:
    """Adds cls, decoded from two votes of 1, 0 or -1 (null counts 0): the class of least loss, the first of equals."""
    votes = [F.coalesce(F.col(c), F.lit(0)) for c in (s1, s2)]
    losses = []
    for code in CODES:
        terms = [-F.exp(-y * v) / 2 for y, v in zip(code, votes, strict=True) if y]
        losses.append(F.round(sum(terms[1:], terms[0]), 9))
    out = F.lit(2)
    for k in (1, 0):
        out = F.when(losses[k] <= F.least(*losses[k + 1 :]) if k == 0 else losses[1] <= losses[2], k).otherwise(out)
    return df.withColumn("cls", out)


def posterior_vote(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Adds vote: 1 where the posterior reaches the threshold, else -1."""
    return df.withColumn("vote", F.when(F.col(p) >= threshold, 1).otherwise(-1))


def decoding_accuracy(df: DataFrame, keys: Keys, true: str = "true", cls: str = "cls") -> DataFrame:
    """Share of rows, in percent, whose decoded class is the true one."""
    return df.groupBy(*keys).agg((100.0 * F.avg(F.when(F.col(true) == F.col(cls), 1.0).otherwise(0.0))).alias("accuracy"))


def confusion_percent(df: DataFrame, true: str, predicted: str) -> DataFrame:
    c = df.groupBy(true, predicted).agg(F.count("*").alias("n"))
    return c.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def class_given_prediction(cm: DataFrame, keys: Keys, true: str = "true", predicted: str = "pred", n: str = "n") -> DataFrame:
    """P(true class | prediction): row percents rounded, a little added, columns made to sum to 1."""
    keys = list(keys)
    row = F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(*keys, true))) + F.lit(2.220446049250313e-16)
    return cm.withColumn("_r", row).withColumn("p", F.col("_r") / F.sum("_r").over(Window.partitionBy(*keys, predicted))).drop("_r")


def features(df: DataFrame, keys: Keys, column: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """One row per key with a vector of the named columns' values."""
    wide = df.groupBy(*keys).pivot(column, list(names)).agg(F.first(value))
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep").transform(wide.fillna(0.0, list(names))).select(*keys, "features")


def train(df: DataFrame, algorithm: str, components: int | None = None, folds: int = 0, seed: int = 1):
    """A fitted MLlib pipeline over features and label: tree, svm-linear, nbayes or nn, with PCA if asked, cross-validated if folds are given."""
    if algorithm not in ("tree", "svm-linear", "nbayes", "nn"):
        raise ValueError(f"unknown algorithm {algorithm}")
    stages, column = [], "features"
    if components:
        stages.append(PCA(k=components, inputCol="features", outputCol="pca"))
        column = "pca"
    width = components or df.select("features").first()[0].size
    model = {"tree": lambda: DecisionTreeClassifier(featuresCol=column, seed=seed), "svm-linear": lambda: LinearSVC(featuresCol=column), "nbayes": lambda: NaiveBayes(featuresCol=column, modelType="gaussian"), "nn": lambda: MultilayerPerceptronClassifier(featuresCol=column, layers=[width, 8, 2], seed=seed)}[algorithm]()
    pipeline = Pipeline(stages=[*stages, model])
    if folds:
        return CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(df)
    return pipeline.fit(df)


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int = 5, most: int = 20_000) -> DataFrame:
    """test with prediction, the majority label of the k nearest training vectors (the smaller label of equals).

    Training sets are cohorts: they go to the tasks in one broadcast, so one beyond `most` rows is refused. Distances are
    taken in blocks of rows by a matrix product; those that can be among the k nearest are then taken exactly, ties in
    the order of the training rows.
    """
    got = train.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("label")).limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} training rows")
    x, y = np.stack(got["f"]), got["label"].to_numpy()
    shipped = train.sparkSession.sparkContext.broadcast((x, y, (x * x).sum(axis=1)))

    @F.pandas_udf(DoubleType())
    def vote(v: pd.Series) -> pd.Series:
        x, y, squares = shipped.value
        n, out = min(k, len(x)), []
        for at in range(0, len(v), 256):
            q = np.stack(v.iloc[at : at + 256])
            rough = squares[None] + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
            cut = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9 * (1 + np.abs(rough).max(axis=1))
            for f, r, c in zip(q, rough, cut, strict=True):
                near = np.flatnonzero(r <= c)
                near = near[np.argsort(((x[near] - f) ** 2).sum(axis=1), kind="stable")[:n]]
                values, counts = np.unique(y[near], return_counts=True)
                out.append(float(values[counts.argmax()]))
        return pd.Series(out)

    return test.withColumn("prediction", vote(vector_to_array("features")))
