"""Symbolic information by blocks against pairs written out, missing samples and short epochs included."""

import math
from collections import Counter

import numpy as np
import pytest

from latticework.operators import signal as S
from latticework.operators import symbolic as Y

SCHEMA = "subject int, channel string, epoch int, sample int, value double"
N, TAUS = 40, [32, 8, 4, 1]


def by_hand(rows, taus):
    at = {r[:4]: r[4] for r in rows if r[4] is not None and 0 <= r[3] < N}
    channels = sorted({r[1] for r in rows})

    def pattern(s, c, e, t, tau):
        v = [at.get((s, c, e, t + k * tau)) for k in range(3)]
        return None if None in v else tuple(sorted(range(3), key=lambda k: (v[k], k)))

    mirrored = lambda p: tuple(reversed(p))
    out = {}
    for s in {r[0] for r in rows}:
        for tau in taus:
            for i, a in enumerate(channels):
                for b in channels[i + 1 :]:
                    each = []
                    for e in {r[2] for r in rows}:
                        both = [(pattern(s, a, e, t, tau), pattern(s, b, e, t, tau)) for t in range(N - 2 * tau)]
                        joint = Counter(p for p in both if None not in p)
                        if not (total := sum(joint.values())):
                            continue
                        left, right = Counter(), Counter()
                        for (x, y), k in joint.items():
                            left[x] += k
                            right[y] += k
                        each.append(sum(k / total * math.log(k * total / (left[x] * right[y])) for (x, y), k in joint.items() if x != y and y != mirrored(x)) / math.log(6))
                    if each:
                        out[s, tau, a, b] = max(0.0, sum(each) / len(each))
    return out


@pytest.fixture(scope="module")
def recording():
    rng = np.random.default_rng(5)
    rows = []
    for s in range(2):
        for e in range(4):
            base = rng.normal(size=N).cumsum()
            for k, c in enumerate(("E1", "E2", "E3", "E4")):
                x = np.round(np.roll(base, 2 * k) + rng.normal(size=N), 1)  # ties occur
                rows += [(s, c, e, t, float(v)) for t, v in enumerate(x) if not (k == 1 and t % 11 == 3)]
    return rows


def test_pairs_by_hand(spark, recording):
    df = spark.createDataFrame([*recording, (0, "E1", 0, N + 3, 9.0), (0, None, 0, 1, 9.0), (1, "E2", 3, 3, None)], SCHEMA)
    names = ["E1", "E2", "E3", "E4"]
    got = {tuple(r)[:4]: r["w"] for r in Y.block_information(Y.information_blocks(df, names, N, TAUS), names).collect()}
    want = by_hand(recording, TAUS)
    assert got == pytest.approx(want, abs=1e-9) and {k[1] for k in got} == {8, 4, 1} and max(got.values()) > 0.02


def test_same_as_joined_patterns(spark, recording):
    """Where no sample is missing, the blocks equal the information of joined patterns."""
    df = spark.createDataFrame([r for r in recording if r[0] == 0 and r[1] != "E2"], SCHEMA).drop("subject")
    names = ["E1", "E3", "E4"]
    got = {tuple(r)[1:3]: r["w"] for r in Y.block_information(Y.information_blocks(df, names, N, [4], ()), names, ()).collect()}
    assert got == pytest.approx({(r["ch_i"], r["ch_j"]): r["w"] for r in S.weighted_symbolic_information(S.symbols(df, 4)).collect()}, abs=1e-9)


def test_no_rows_and_no_channels(spark, recording):
    empty = spark.createDataFrame([], SCHEMA)
    assert Y.block_information(Y.information_blocks(empty, ["E1", "E2"], N, TAUS), ["E1", "E2"]).count() == 0
    assert Y.block_information(Y.information_blocks(spark.createDataFrame(recording, SCHEMA), [], N, TAUS), []).count() == 0


def test_no_pairs_are_joined(spark, recording):
    df = spark.createDataFrame(recording, SCHEMA)
    plan = Y.block_information(Y.information_blocks(df, ["E1", "E2"], N, TAUS), ["E1", "E2"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_epochs_split_evenly(spark):
    df = spark.createDataFrame([(0, "a", e, t, float(10 * e + t)) for e in range(2) for t in range(11)], SCHEMA)
    got = sorted((r["epoch"], r["sample"], r["value"]) for r in S.split_epochs(df, 10, 5).collect())
    assert got == [(e * 5 + t // 2, t % 2, float(10 * e + t)) for e in range(2) for t in range(10)]
    with pytest.raises(ValueError, match="equal parts"):
        S.split_epochs(df, 11, 5)
