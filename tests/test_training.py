"""Trees, nested cross-validation, ensembles and support vector machines against plain versions."""

import itertools
import math

import numpy as np
import pytest

from latticework.operators import svm as V
from latticework.operators import training as T
from latticework.plans import ensembles as E

SF = "/root/testdata/sf0.001"


def test_first_split_is_the_best_of_all_edges():
    rng = np.random.default_rng(1)
    for _ in range(20):
        z, y = np.round(rng.normal(size=(14, 3)), 1), rng.integers(0, 2, 14)
        feature, threshold, _ = T.grow(z, y, 1)
        cost = lambda side: sum(s.sum() * (len(s) - s.sum()) / max(1, len(s)) for s in side)
        every = {(f, t): cost((y[z[:, f] <= t], y[z[:, f] > t])) for f in range(3) for t in z[:, f]}
        if feature[0] >= 0:
            assert cost((y[z[:, feature[0]] <= threshold[0]], y[z[:, feature[0]] > threshold[0]])) == pytest.approx(min(every.values())) and threshold[0] not in z[:, feature[0]]
        else:
            assert min(every.values()) == pytest.approx(cost((y,)))


def walk(model, x):
    mean, axes, feature, threshold, majority = model
    z = [(sum((v - m) * a for v, m, a in zip(x, mean, axes[k * len(mean) : (k + 1) * len(mean)], strict=True))) for k in range(len(axes) // len(mean))]
    node = 0
    while feature[node] >= 0:
        node = 2 * node + 1 + (z[feature[node]] > threshold[node])
    return majority[node]


def table(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for key, noise in (("clear", 0.1), ("vague", 1.5), ("none", 50.0)):
        for u in range(n):
            label = u % 2
            rows.append((key, u, label, [float(v) for v in rng.normal(size=5) * noise + np.array([label, -label, 0, 2 * label, 1])]))
    rows += [("clear", 1000, 1, None), ("clear", 1001, 0, [math.nan] * 5), ("vague", 1002, None, [0.0] * 5), ("vague", 1003, 7, [0.0] * 5)]
    return spark.createDataFrame(rows, "member string, unit long, label int, features array<double>")


def test_members(spark):
    df = table(spark)
    got = {r["member"]: r for r in T.train_members(df, ["member"]).collect()}
    assert got["clear"]["accuracy"] > 95 and 30 < got["none"]["accuracy"] < 70
    assert all(r["n"] == r["tn"] + r["fp"] + r["fn"] + r["tp"] == 90 for r in got.values())
    members = T.train_members(df, ["member"])
    preds = T.predict_members(df.filter("unit < 90"), members, ["member"]).collect()
    assert len(preds) == 270
    for r in preds:
        m = got[r["member"]]
        assert r["pred"] == walk((m["mean"], m["axes"], m["feature"], m["threshold"], m["majority"]), r["features"])


def test_held_out_counts_come_from_rows_that_took_no_part(spark):
    """With labels by chance, a fit to the same rows would beat chance clearly; held-out counts don't."""
    rng = np.random.default_rng(0)
    rows = [(k, u, int(rng.integers(2)), rng.normal(size=6).tolist()) for k in range(6) for u in range(120)]
    got = T.train_members(spark.createDataFrame(rows, "member int, unit long, label int, features array<double>"), ["member"]).collect()
    assert 42 < np.mean([r["accuracy"] for r in got]) < 58


def test_bounded_cohorts(spark):
    n = T.train_members(table(spark, 400).filter("member = 'clear'"), ["member"], most=100).first()["n"]
    assert 60 <= n <= 150


def test_ensemble_equals_plain_products(spark):
    got = E.ensemble_posteriors(spark, SF).collect()
    members = {(r["g0"], r["g1"], r["member"]): r for r in E.members(spark, SF).collect()}
    rest = {(r["g0"], r["g1"], r["unit"], r["member"]): r["features"] for r in E.cohort(spark, SF, False).collect()}
    want = {}
    for (g0, g1), own in itertools.groupby(sorted(members), key=lambda k: k[:2]):
        order = sorted(own, key=lambda k: (-members[k]["accuracy"], k))
        for unit in {k[2] for k in rest if k[:2] == (g0, g1)}:
            product = np.ones(2)
            for step, key in enumerate(order, 1):
                m = members[key]
                pred = walk((m["mean"], m["axes"], m["feature"], m["threshold"], m["majority"]), rest[g0, g1, unit, key[2]])
                cm = np.array([[m["tn"], m["fp"]], [m["fn"], m["tp"]]], float)
                cm = np.floor(cm * 100 / cm.sum(axis=1, keepdims=True) + 0.5) + 2.220446049250313e-16
                cm /= cm.sum(axis=0)
                product = product * cm[:, pred]
                product /= product.sum()
                for cls in (0, 1):
                    want[g0, g1, unit, step, cls] = product[cls]
    assert {(r["g0"], r["g1"], r["unit"], r["perf_rank"], r["cls"]): r["posterior"] for r in got} == pytest.approx(want, abs=1e-8)


def ring(rng, n):
    angle, far = rng.uniform(0, 2 * math.pi, n), np.arange(n) % 2
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (0.4 + 1.2 * far + 0.1 * rng.normal(size=n))[:, None]
    return x, np.where(far, 1.0, -1.0)


def plain_machine(x, y, box, scale, rounds=4000):
    """The dual with the bias as a multiplier: every pair in turn moved to its own optimum, many times over."""
    n, k = len(y), V.kernel(x, x, scale)
    alpha = np.zeros(n)
    for _ in range(rounds):
        moved = 0.0
        for i in range(n):
            for j in range(i):
                f = k @ (alpha * y)
                curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
                step = ((y[i] - f[i]) - (y[j] - f[j])) / curve
                lo, hi = max(-alpha[i] if y[i] > 0 else alpha[i] - box, alpha[j] - box if y[j] > 0 else -alpha[j]), min(box - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else box - alpha[j])
                step = min(max(step, lo), hi)
                alpha[i] += y[i] * step
                alpha[j] -= y[j] * step
                moved = max(moved, abs(step))
        if moved < 1e-10:
            break
    f = k @ (alpha * y)
    free = (alpha > 1e-7) & (alpha < box - 1e-7)
    return f + (y - f)[free].mean()


@pytest.mark.parametrize("box, scale", [(1.0, 1.0), (10.0, 0.7)])
def test_margins_equal_a_plain_solver(box, scale):
    x, y = ring(np.random.default_rng(2), 24)
    assert V.fit(x, y, box, scale, 1e-9).margins(x) == pytest.approx(plain_machine(x, y, box, scale), abs=1e-4)


def test_a_ring_is_separated(spark):
    x, y = ring(np.random.default_rng(4), 300)
    rows = [(k, int(c > 0), v.tolist()) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, 1, None), (901, 0, [1.0, math.inf]), (902, 1, [1.0])], "unit long, label int, features array<double>")
    got = {r["unit"]: r for r in V.svm_posteriors(df.filter("unit < 200"), df.drop("label")).collect()}
    assert np.mean([got[k]["vote"] == y[k] for k in range(200, 300)]) > 0.97
    assert all(0 < got[k]["p"] < 1 for k in range(300)) and all(got[k]["vote"] is None and got[k]["p"] is None for k in (900, 901, 902))
    with pytest.raises(ValueError, match="both classes"):
        V.svm_posteriors(df.filter("label = 1"), df)


def test_calibration_is_at_the_least_loss():
    rng = np.random.default_rng(6)
    m = rng.normal(size=200)
    y = np.where(rng.random(200) < 1 / (1 + np.exp(-2 * m - 0.5)), 1.0, -1.0)
    a, b = V.calibrated(m, y)
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    loss = lambda a, b: float((np.logaddexp(0, a * m + b) - (1 - t) * (a * m + b)).sum())
    assert loss(a, b) <= min(loss(a + i * 0.02, b + j * 0.02) for i in range(-20, 21) for j in range(-20, 21)) + 1e-9
    p = 1 / (1 + np.exp(a * m + b))
    best = V.best_threshold(p, y)
    gap = lambda v: abs(((p >= v) & (y > 0)).sum() / ones - ((p >= v) & (y <= 0)).sum() / zeros)
    assert gap(best) == pytest.approx(max(gap(v) for v in p))


def test_posteriors_query(spark):
    got = E.svm_query(spark, SF).collect()
    assert got and all(0 <= r["p"] <= 1 and r["vote"] in (-1, 1) for r in got)
