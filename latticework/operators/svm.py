"""Radial-basis support vector machines by working-set pairs, posteriors calibrated on cross-fitted margins, votes at the best threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows an SVM learns from, at most about so many; their kernel matrix is held whole (32 MB).
MOST = 2000


def kernel(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """exp(-|x - y|^2 / scale^2)."""
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-np.maximum(apart, 0) / scale**2)


@dataclass
class Machine:
    support: np.ndarray
    weight: np.ndarray
    bias: float
    scale: float

    def margins(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """In blocks of rows, so that a task's memory doesn't follow their number."""
        return np.concatenate([np.zeros(0), *[kernel(x[k : k + block], self.support, self.scale) @ self.weight + self.bias for k in range(0, len(x), block)]])


def fit(x: np.ndarray, y: np.ndarray, box: float = 1.0, scale: float = 1.0, tolerance: float = 1e-6, most_steps: int = 200_000) -> Machine:
    """The dual solved two variables at a time: the one that violates most, and with it the one that gains most; y is -1 or 1."""
    k = kernel(x, x, scale)
    alpha, slope, own = np.zeros(len(y)), -np.ones(len(y)), np.diag(k)  # slope of the dual
    for _ in range(most_steps):
        up = ((y > 0) & (alpha < box)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < box))
        v = -y * slope
        if not up.any() or not low.any():
            break
        i = int(np.where(up, v, -np.inf).argmax())
        if v[i] - np.where(low, v, np.inf).min() < tolerance:
            break
        gap = v[i] - v
        curve = np.maximum(own[i] + own - 2 * k[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        step = min(step, box - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else box - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        slope += step * y * (k[i] - k[j])
        for m in (i, j):
            alpha[m] = 0.0 if alpha[m] < 1e-12 * box else box if alpha[m] > box * (1 - 1e-12) else alpha[m]
    free = (alpha > 0) & (alpha < box)
    v = -y * slope
    up = ((y > 0) & (alpha < box)) | ((y < 0) & (alpha > 0))
    low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < box))
    if free.any():
        bias = float(v[free].mean())
    else:
        sides = [m for m in (v[up].max() if up.any() else None, v[low].min() if low.any() else None) if m is not None]
        bias = float(np.mean(sides)) if sides else 0.0
    held = alpha > 0
    return Machine(x[held], (alpha * y)[held], bias, scale)


def calibrated(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope a and offset b of P(1) = 1 / (1 + exp(a * margin + b)) by Newton steps on the likelihood, targets drawn in by the classes' sizes."""
    ones, zeros = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 0.0, math.log((zeros + 1) / (ones + 1))

    def loss(a: float, b: float) -> float:
        f = a * margins + b
        return float((np.logaddexp(0, f) - (1 - target) * f).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(a * margins + b, -500, 500)))
        d, w = target - p, p * (1 - p)
        g = np.array([(d * margins).sum(), d.sum()])
        if np.abs(g).max() < 1e-9:
            break
        h = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-12 * np.eye(2)
        move, now, size = -np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-10 and loss(a + size * move[0], b + size * move[1]) > now + 1e-4 * size * float(g @ move):
            size /= 2
        if size <= 1e-10:
            break
        a, b = a + size * move[0], b + size * move[1]
    return float(a), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The posterior at or above which the rates of the classes differ most, the largest of equals."""
    order = np.argsort(-p, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    tp, fp = np.cumsum(y[order] > 0)[ends], np.cumsum(y[order] <= 0)[ends]
    gap = np.abs(tp * (y <= 0).sum() - fp * (y > 0).sum())
    return float(p[order][ends[int(gap.argmax())]])


def learn(x: np.ndarray, y: np.ndarray, fold: np.ndarray, box: float = 1.0, scale: float = 1.0) -> tuple[Machine, float, float, float]:
    """The machine of all rows, and the calibration and threshold from margins of rows that a fold's machine did not learn from."""
    held = np.zeros(len(y))
    for k in np.unique(fold):
        own = fold != k
        if len(np.unique(y[own])) == 2:
            held[~own] = fit(x[own], y[own], box, scale).margins(x[~own])
    a, b = calibrated(held, y)
    return fit(x, y, box, scale), a, b, best_threshold(1 / (1 + np.exp(a * held + b)), y)


def svm_posteriors(known: DataFrame, rows: DataFrame, box: float = 1.0, scale: float = 1.0, folds: int = 5, most: int = MOST) -> DataFrame:
    """rows' unit, with margin, p (of class 1) and vote (1 or -1) by a machine that learns from `known` (unit, label 0 or 1, features).

    About `most` of the known rows are taken, by a hash of unit and features, so that neither their number nor a frequent
    unit sets the driver's memory; machine, calibration and threshold go to the tasks as one broadcast bounded by that.
    Rows, any number, are scored in blocks. Rows with a null or non-finite feature, or of another dimension than the
    commonest known one, get nulls. Both classes must be known.
    """
    finite = lambda: F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = known.filter(F.col("label").isin(0, 1) & finite()).select("label", F.transform("features", lambda v: v.cast("double")).alias("features"), F.xxhash64("unit", "features").alias("h"))
    n = fine.count()
    some = fine.filter(F.pmod(F.shiftright("h", 20), F.lit(1 << 30)) * F.lit(float(n)) < F.lit(float(most) * (1 << 30))).limit(2 * most).toPandas().sort_values(["h", "label"])
    width = int(some["features"].map(len).mode().iloc[0]) if len(some) else 0
    some = some[some["features"].map(len) == width] if len(some) else some
    if some["label"].nunique() != 2:
        raise ValueError("rows of both classes, 0 and 1, are needed to learn from")
    x, y = np.stack(some["features"]).astype(float), np.where(some["label"].to_numpy() == 1, 1.0, -1.0)
    shipped = rows.sparkSession.sparkContext.broadcast(learn(x, y, some["h"].to_numpy() % folds, box, scale))
    kind = dict(rows.dtypes)["unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, a, b, threshold = shipped.value
        for batch in batches:
            held = np.asarray(batch.column("fits"))
            flat = batch.column("features").filter(batch.column("fits"))
            margin, p = np.full(len(held), np.nan), np.full(len(held), np.nan)
            if held.any():
                margin[held] = machine.margins(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                p[held] = 1 / (1 + np.exp(a * margin[held] + b))
            vote = np.where(p >= threshold, 1, -1)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(margin, mask=~held), pa.array(p, mask=~held), pa.array(vote.astype(np.int32), mask=~held)], ["unit", "margin", "p", "vote"])

    fits = F.coalesce(finite() & (F.size("features") == width), F.lit(False))
    return rows.select("unit", F.transform("features", lambda v: v.cast("double")).alias("features"), fits.alias("fits")).mapInArrow(run, f"unit {kind}, margin double, p double, vote int")
