"""Cross-spectra by blocks against plain numpy, whole and in odd shapes."""

import numpy as np
import pytest

from latticework.operators import signal as S
from latticework.operators import spectra as P


def plain(rows, channels, rate, n, smoothing, lo, hi):
    """{(subject, freq, ch_i, ch_j): w} and {(subject, freq, channel): power}, one epoch, pair and frequency at a time."""
    own = S.tapers(n, max(1.0, smoothing * n / rate))
    size = 1 << (n - 1).bit_length()
    freqs = np.fft.rfftfreq(size, 1 / rate)
    epochs: dict = {}
    for subject, channel, epoch, sample, value in rows:
        if value is not None and 0 <= sample < n and channel in channels:
            epochs.setdefault((subject, epoch), {}).setdefault(channel, np.zeros(n))[sample] += value
    pairs, power = {}, {}
    for (subject, _), waves in epochs.items():
        spectra = {c: np.array([np.fft.rfft(t * x, size) for t in own]) for c, x in waves.items()}
        for f in np.flatnonzero((freqs >= lo) & (freqs <= hi)):
            for a in spectra:
                power.setdefault((subject, freqs[f], a), []).append((np.abs(spectra[a][:, f]) ** 2).mean() * 2 / rate)
                for b in spectra:
                    if a < b:
                        pairs.setdefault((subject, freqs[f], a, b), []).append((spectra[a][:, f] * spectra[b][:, f].conj()).mean().imag)
    w = {}
    for k, im in pairs.items():
        im = np.array(im)
        below = np.abs(im).sum() ** 2 - (im**2).sum()
        w[k] = (im.sum() ** 2 - (im**2).sum()) / below if below else None
    return w, {k: np.mean(v) for k, v in power.items()}


def signal_rows(rng, subjects, channels, epochs, n, rate):
    rows = []
    for s in subjects:
        for e in range(epochs):
            phase = rng.uniform(0, 2 * np.pi)
            for k, c in enumerate(channels):
                if s == "b" and c == "E3" and e % 2:
                    continue  # a channel that misses every other epoch of one subject
                x = np.sin(2 * np.pi * 10 * np.arange(n) / rate + phase - 0.6 * k) + rng.normal(size=n)
                rows += [(s, c, e, t, float(v)) for t, v in enumerate(x)]
    return rows


SCHEMA = "subject string, channel string, epoch int, sample int, value double"


def test_blocks_equal_numpy(spark):
    rng = np.random.default_rng(1)
    channels = ["E1", "E10", "E2", "E3"]
    rows = signal_rows(rng, ["a", "b", None], channels, 9, 125, 125.0)
    rows += [("a", "E1", 0, 500, 9.0), ("a", "E1", 0, 3, None), ("a", "other", 0, 3, 5.0), ("a", None, 0, 3, 5.0), ("b", "E1", 0, 7, 2.5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    blocks = P.cross_blocks(df, channels, 125.0, 125, 1.5, 5.0, 20.0).cache()
    want_w, want_p = plain(rows, channels, 125.0, 125, 1.5, 5.0, 20.0)
    got = {tuple(r)[:4]: r["w"] for r in P.block_wpli(blocks, channels).collect()}
    assert got.keys() == want_w.keys() and all(got[k] == pytest.approx(want_w[k], rel=1e-9) for k in got)
    got = {tuple(r)[:3]: r["power"] for r in P.block_power(blocks, channels).collect()}
    assert got.keys() == want_p.keys() and all(got[k] == pytest.approx(want_p[k], rel=1e-9) for k in got)
    near = [w for (s, f, a, b), w in want_w.items() if abs(f - 10) < 0.6 and (a, b) == ("E1", "E10")]
    assert min(near) > 0.5  # a steady lag shows


def test_plan_has_no_join_and_two_shuffles(spark):
    df = spark.createDataFrame(signal_rows(np.random.default_rng(2), ["a"], ["E1", "E2"], 2, 32, 32.0), SCHEMA)
    plan = P.block_wpli(P.cross_blocks(df, ["E1", "E2"], 32.0, 32, 1.0, 1.0, 15.0), ["E1", "E2"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Generate" not in plan and plan.count("Exchange") == 2


def test_one_key_is_dealt_to_many_tasks(spark):
    """Blocks of many tasks add up to the same sums; the number of blocks follows tasks, not epochs."""
    rows = signal_rows(np.random.default_rng(3), ["a"], ["E1", "E2", "E3"], 40, 32, 32.0)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r)[:4]: r["w"] for r in P.block_wpli(P.cross_blocks(df.repartition(1), ["E1", "E2", "E3"], 32.0, 32, 1.0, 1.0, 15.0), ["E1", "E2", "E3"]).collect()}
    want, _ = plain(rows, ["E1", "E2", "E3"], 32.0, 32, 1.0, 1.0, 15.0)
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k], rel=1e-9) for k in whole)


def test_windows_instead_of_tapers_are_the_plain_transform(spark):
    rows = signal_rows(np.random.default_rng(4), ["a"], ["E1", "E2", "E3"], 6, 24, 24.0)
    df = spark.createDataFrame(rows, SCHEMA).drop("subject")
    want = {(float(r["bin"]), r["ch_i"], r["ch_j"]): r["w"] for r in S.debiased_wpli(S.cross_spectrum(S.fourier(df, 24, 11))).collect()}
    got = {(r["freq"], r["ch_i"], r["ch_j"]): r["w"] for r in P.block_wpli(P.cross_blocks(df, ["E1", "E2", "E3"], 24.0, 24, lo=1.0, hi=11.0, keys=(), windows=np.ones((1, 24))), ["E1", "E2", "E3"], ()).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_no_rows_and_no_channels(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.block_wpli(P.cross_blocks(df, [], 32.0, 32, 1.0, 1.0, 15.0), []).count() == 0
    assert P.block_power(P.cross_blocks(df, ["E1"], 32.0, 32, 1.0, 1.0, 15.0), ["E1"]).count() == 0
