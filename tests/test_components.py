"""Independent components in blocks against those of one block, gaps, nulls and recordings that can't be taken apart."""

import numpy as np
import pytest

from latticework.operators.components import independent_components

SCHEMA = "subject string, channel string, sample int, value double"


@pytest.fixture(scope="module")
def recordings():
    """Subjects a and None mix three sources, with an offset; b is flat, c has one sample."""
    rng = np.random.default_rng(7)
    n, rows, clean = 900, [], {}
    for s in ("a", None):
        calm = np.stack([np.sin(np.arange(n) * 0.31), np.sign(np.sin(np.arange(n) * 0.017))])
        spikes = (rng.random(n) < 0.02) * 20.0
        mix = rng.normal(size=(3, 3))
        x = mix @ np.vstack([calm, spikes]) + 1000.0
        clean[s] = mix[:, :2] @ calm
        rows += [(s, f"c{k}", t, float(x[k, t])) for k in range(3) for t in range(n) if (k, t) != (1, 450)]
        rows += [(s, "c0", 5, float(x[0, 5]))]  # a repeated sample
    rows += [("b", c, t, 4.0) for c in ("x", "y") for t in range(50)] + [("c", "x", 0, 1.5), ("c", "y", 0, float("nan")), ("c", "y", 1, None), (None, None, 3, 1.0)]
    rows += [("d", f"c{t % 2}", t, float(t)) for t in range(600)]  # no sample is complete
    return rows, clean


def taken(frame):
    return {tuple(r)[:3]: r["value"] for r in frame.collect()}


def test_blocks_give_what_one_block_gives(spark, recordings):
    rows, clean = recordings
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole, parts = (taken(independent_components(df, reject=[0], block=b, rounds=60)) for b in (1 << 13, 256))
    assert whole.keys() == parts.keys() and max(abs(whole[k] - parts[k]) for k in whole) < 1e-6
    assert not any(k[2] == 450 and k[0] not in ("b", "c", "d") for k in whole) and len([k for k in whole if k[0] == "a"]) == 3 * 899
    assert [whole["b", c, t] for c in ("x", "y") for t in (0, 49)] == [4.0] * 4 and ("c", "x", 0) in whole
    assert {k: v for k, v in parts.items() if k[0] == "d"} == {("d", f"c{t % 2}", t): float(t) for t in range(600)}
    for s, source in clean.items():
        for k in range(3):
            own = np.array([parts[s, f"c{k}", t] for t in range(900) if t != 450])
            assert abs(np.corrcoef(own, np.delete(source[k], 450))[0, 1]) > 0.97


def test_none_rejected_changes_nothing(spark, recordings):
    df = spark.createDataFrame([r for r in recordings[0] if r[0] == "a"], SCHEMA)
    got = taken(independent_components(df, block=300, rounds=5))
    want = {r[:3]: r[3] for r in recordings[0] if r[0] == "a" and r[2] != 450}
    assert got == pytest.approx(want, abs=1e-6)
    assert independent_components(spark.createDataFrame([], SCHEMA)).count() == 0
