"""Classifiers trained for many keys at once: small trees on principal components, choices and confusion by nested cross-validation, ensembles in order of their held-out performance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.classify import bayes, class_given_prediction

Keys = Sequence[str]
#: (principal components, 0 for none; depth) that cross-validation chooses from.
GRID = tuple(product((0, 2, 4), (1, 2, 3)))
#: Thresholds tried for a feature at a split, at most: quantiles of the values there.
BINS = 16
#: Rows of one key that training takes, at most: a cohort's subjects.
MOST = 5000


def projection(x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (features by components) of the largest principal components, each with its largest entry positive; none leaves the features as they are."""
    if not components:
        return np.zeros(x.shape[1]), np.eye(x.shape[1])
    mean = x.mean(axis=0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][:components].T
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def impurity(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ones * (n - ones) / np.maximum(n, 1)


def grow(z: np.ndarray, y: np.ndarray, depth: int) -> tuple[list[int], list[float], list[int]]:
    """A tree as a heap: each node's feature (-1 for a leaf), threshold and majority (0 of equals). Splits are the best of a histogram's edges by Gini impurity, the first feature and lowest edge of equals, midway to the next value."""
    size = 2 ** (depth + 1) - 1
    feature, threshold, majority = [-1] * size, [0.0] * size, [0] * size
    rows: dict[int, np.ndarray] = {0: np.arange(len(y))}
    for node in range(size):
        own = rows.get(node)
        if own is None or not len(own):
            continue
        ones = int(y[own].sum())
        majority[node] = int(2 * ones > len(own))
        if 2 * node + 2 >= size or ones in (0, len(own)):
            continue
        best = (impurity(np.array([ones]), np.array([len(own)]))[0] - 1e-12, -1, 0.0)
        for f in range(z.shape[1]):
            v = z[own, f]
            edges = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            edges = edges[edges < v.max()]
            if not len(edges):
                continue
            bins = np.searchsorted(edges, v, side="left")
            n, own_ones = (np.cumsum(np.bincount(bins, w, len(edges) + 1))[:-1] for w in (None, y[own].astype(float)))
            left = impurity(own_ones, n) + impurity(ones - own_ones, len(own) - n)
            k = int(left.argmin())
            if left[k] < best[0] - 1e-12:
                best = (left[k], f, float((edges[k] + v[v > edges[k]].min()) / 2))
        if best[1] >= 0:
            feature[node], threshold[node] = best[1], best[2]
            right = z[own, best[1]] > best[2]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return feature, threshold, majority


def fitted(x: np.ndarray, y: np.ndarray, components: int, depth: int) -> tuple:
    mean, axes = projection(x, components)
    return mean, axes, *grow((x - mean) @ axes, y, depth)


def predicted(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, axes, feature, threshold, majority = model
    z, node = (x - mean) @ axes, np.zeros(len(x), int)
    f, t = np.array(feature), np.array(threshold)
    for _ in range(len(feature).bit_length()):
        inner = f[node] >= 0
        node[inner] = 2 * node[inner] + 1 + (z[inner, f[node[inner]]] > t[node[inner]])
    return np.array(majority)[node]


def chosen(x: np.ndarray, y: np.ndarray, fold: np.ndarray, grid: Sequence[tuple[int, int]]) -> tuple[int, int]:
    """The grid's entry with the most right held-out predictions over the folds, the first of equals."""
    right = []
    for components, depth in grid:
        right.append(0)
        for k in np.unique(fold):
            own = fold != k
            if own.any() and components <= x.shape[1]:
                right[-1] += int((predicted(fitted(x[own], y[own], components, depth), x[~own]) == y[~own]).sum())
    return tuple(grid[int(np.argmax(right))])


_MODEL = "mean array<double>, axes array<double>, feature array<int>, threshold array<double>, majority array<int>"


def train_members(df: DataFrame, keys: Keys, folds: int = 5, grid: Sequence[tuple[int, int]] = GRID, most: int = MOST) -> DataFrame:
    """keys, n, tn, fp, fn, tp, accuracy and the model of each key, from df(keys, unit, label 0 or 1, features).

    One shuffle brings each key's rows together; folds are masks, by a hash of the unit, so all keys deal a unit alike.
    For each fold, components and depth are chosen by cross-validation over the other folds, and the fold is predicted
    by a tree fitted to them: the counts are of predictions of rows that took no part in any choice. The model that
    leaves is fitted to all rows. Keys are designs and rows their subjects: of a key with more than `most` about so many
    are taken, by the hash. Rows without a label or with a null or non-finite feature take no part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fine = F.col("label").isin(0, 1) & F.col("unit").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.filter(fine).select(*keys, F.col("label").cast("int").alias("label"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.xxhash64("unit").alias("_h"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    share = F.pmod(F.shiftright("_h", 20), F.lit(1 << 30)) * F.col("_n") < F.lit(float(most) * (1 << 30))
    rows = rows.join(sizes, list(keys)).filter(share).drop("_n")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h", "ascending"), ("label", "ascending")])
        y, h = t["label"].to_numpy(), t["_h"].to_numpy()
        x = np.array(t["features"].to_pylist(), float).reshape(len(y), -1)
        fold, held = h % folds, np.zeros(len(y), int)
        for k in np.unique(fold):
            own = fold != k
            if own.any():
                held[~own] = predicted(fitted(x[own], y[own], *chosen(x[own], y[own], fold[own], grid)), x[~own])
        mean, axes, feature, threshold, majority = fitted(x, y, *chosen(x, y, fold, grid))
        c = np.bincount(2 * y + held, minlength=4)
        made = {"n": len(y), "tn": int(c[0]), "fp": int(c[1]), "fn": int(c[2]), "tp": int(c[3]), "accuracy": 100.0 * float(c[0] + c[3]) / len(y)}
        model = {"mean": mean.tolist(), "axes": axes.T.ravel().tolist(), "feature": feature, "threshold": threshold, "majority": majority}
        kind = {"accuracy": pa.float64(), "mean": pa.list_(pa.float64()), "axes": pa.list_(pa.float64()), "feature": pa.list_(pa.int32()), "threshold": pa.list_(pa.float64()), "majority": pa.list_(pa.int32())}
        return pa.table({**{k: t[k].slice(0, 1) for k in keys}, **{name: pa.array([v], kind.get(name, pa.int64())) for name, v in (made | model).items()}})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, tn long, fp long, fn long, tp long, accuracy double, " + _MODEL
    return rows.groupBy(*keys).applyInArrow(run, schema)


def predict_members(df: DataFrame, members: DataFrame, keys: Keys) -> DataFrame:
    """df with `pred` by its key's model, in expressions: projections, then a walk down the heap."""
    both = df.join(members.select(*keys, "mean", "axes", "feature", "threshold", "majority"), list(keys))
    width = F.size("mean")
    dot = lambda k: F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0.0), lambda s, i: s + (F.get("features", i).cast("double") - F.get("mean", i)) * F.get("axes", k * width + i))
    z = F.transform(F.sequence(F.lit(0), (F.size("axes") / width).cast("int") - 1), dot)

    def down(node: Column, _: Column) -> Column:
        f = F.get("feature", node)
        return F.when(f < 0, node).otherwise(2 * node + 1 + (F.get("_z", f) > F.get("threshold", node)).cast("int"))

    leaf = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size("feature").cast("double"))).cast("int")), F.lit(0), down)
    return both.withColumn("_z", z).withColumn("pred", F.get("majority", leaf)).drop("_z", "mean", "axes", "feature", "threshold", "majority")


def member_order(members: DataFrame, pair: Keys, keys: Keys) -> DataFrame:
    """pair, keys, perf_rank: each pair's members by falling held-out accuracy, ties in order of their keys. A pair's members are few."""
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("accuracy"), *[k for k in keys if k not in pair]))
    return members.select(*keys, rank.alias("perf_rank"))


def ensemble(predictions: DataFrame, members: DataFrame, pair: Keys, keys: Keys) -> DataFrame:
    """pair, unit, perf_rank, cls, posterior: each unit's evidence added member by member, best first: products of P(class | prediction) from the members' held-out confusion, normalised at each step."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), F.col(c).cast("double").alias("n")) for t, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])).alias("c")
    given = class_given_prediction(members.select(*keys, cells).select(*keys, "c.*"), keys).select(*keys, F.col("true").alias("cls"), "pred", "p")
    evidence = predictions.select(*keys, "unit", "pred").join(given, [*keys, "pred"]).join(member_order(members, pair, keys), list(keys))
    return bayes(evidence, [*pair, "unit"], "perf_rank").select(*pair, "unit", "perf_rank", "cls", "posterior")
