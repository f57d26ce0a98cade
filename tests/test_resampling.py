"""Polyphase resampling and removal of a line by its harmonic F test."""

import math

import numpy as np
import pytest

from latticework.operators import signal as S


def signal(spark, x, channel="a", first=0):
    return spark.createDataFrame([(channel, first + t, float(v)) for t, v in enumerate(x)], "channel string, sample long, value double")


def series(df):
    rows = sorted((r["sample"], r["value"]) for r in df.collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


@pytest.mark.parametrize("rate, to", [(300, 250), (500, 250), (1000, 250), (256, 250)])
def test_a_sine_keeps_amplitude_and_phase(rate, to):
    t = np.arange(8 * rate)
    ratio = S.Fraction(to, rate)
    for f in (1.0, 10.0, 40.0, 100.0):
        new, y = S.polyphase(t, np.sin(2 * math.pi * f * t / rate + 0.7), ratio.numerator, ratio.denominator)
        inner = (new > to) & (new < 7 * to)
        assert np.abs(y - np.sin(2 * math.pi * f * new / to + 0.7))[inner].max() < 1e-4, f


def test_what_lies_beyond_is_filtered_out():
    t = np.arange(4000)
    new, y = S.polyphase(t, np.sin(2 * math.pi * 180 * t / 500), 1, 2)
    assert np.abs(y[200:-200]).max() < 1e-3
    assert S.polyphase(t, np.full(4000, 3.5), 5, 6)[1] == pytest.approx(3.5)


def test_blocks_of_a_long_channel_agree_with_the_whole(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=2400))
    at, y = series(S.filtered(signal(spark, x), 300.0, None, None, 250.0, block=500))
    new, want = S.polyphase(np.arange(2400), x, 5, 6)
    assert at.tolist() == new.tolist() and y == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="below"):
        S.filtered(signal(spark, x[:10]), 200.0, resample_to=250.0)


def test_a_drifting_line_goes_and_the_rest_stays(spark):
    rate, n = 250.0, 250 * 24
    rng = np.random.default_rng(2)
    t = np.arange(n) / rate
    clean = np.sin(2 * math.pi * 10 * t) + 0.5 * rng.normal(size=n) + 40.0
    line = (1 + 0.4 * np.sin(2 * math.pi * 0.03 * t)) * 3 * np.sin(2 * math.pi * 50 * t + 0.2 * t / 10)
    at, got = series(S.remove_harmonic(signal(spark, clean + line, first=1000), rate, block=2000))
    assert at.tolist() == list(range(1000, 1000 + n))
    left = lambda x, f: abs(np.exp(-2j * math.pi * f * t) @ (x - 40)) / n * 2
    assert np.sqrt(((got - clean) ** 2).mean()) < 0.12 < np.sqrt((line**2).mean()) / 10
    assert left(got, 10) == pytest.approx(left(clean, 10), rel=0.01)


def test_a_signal_without_a_line_stays(spark):
    x = np.random.default_rng(3).normal(size=250 * 16)
    _, got = series(S.remove_harmonic(signal(spark, x), 250.0, p=1e-6))
    assert (got == x).all()


def test_gaps_short_channels_and_nulls(spark):
    rate = 100.0
    t = np.arange(3000)
    x = 2 * np.sin(2 * math.pi * 25 * t / rate + 1) + 0.05 * np.random.default_rng(4).normal(size=3000)
    df = signal(spark, x).filter("sample < 700 or sample > 1900").unionByName(signal(spark, [1.0, 2.0, None or 3.0], "short"))
    df = df.unionByName(spark.createDataFrame([("a", 800, None), ("none", 5, None)], df.schema))
    got = S.remove_harmonic(df, rate, 25.0).collect()
    own = {r["sample"]: r["value"] for r in got if r["channel"] == "a"}
    assert set(own) == {*range(700), *range(1901, 3000)}
    assert np.std(list(own.values())) < 0.15
    assert sorted(r["value"] for r in got if r["channel"] == "short") == [1.0, 2.0, 3.0] and not [r for r in got if r["channel"] == "none"]
