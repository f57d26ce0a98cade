"""Epochs, references, spectra and phase connectivity over samples(channel, epoch, sample, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.scalar import r9


def epochs(df: DataFrame, seconds: int, time: str = "t", rate_column: str | None = None) -> DataFrame:
    """Adds the epoch of `seconds` that the time, in seconds, falls into."""
    return df.withColumn("epoch", F.floor(F.col(time) / seconds).cast("int"))


def split_epochs(df: DataFrame, n: int, parts: int = 5) -> DataFrame:
    """Each epoch of n samples as `parts` epochs of their own, numbered through; samples are counted anew. Samples outside 0 to n - 1 take no part; n that can't be split evenly is refused."""
    if n % parts:
        raise ValueError(f"{n} samples can't be split into {parts} equal parts")
    size = n // parts
    own = df.filter(F.col("sample").between(0, n - 1))
    return own.withColumns({"epoch": (F.col("epoch") * parts + F.floor(F.col("sample") / size)).cast("int"), "sample": (F.col("sample") % size).cast("int")})


def complete_epochs(df: DataFrame, samples: int, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Drops epochs with fewer than `samples` samples."""
    full = df.groupBy(*keys, "epoch").count().filter(F.col("count") >= samples).select(*keys, "epoch")
    return df.join(full, [*keys, "epoch"], "left_semi")


def remove_baseline(df: DataFrame, keys: Sequence[str] = ("channel", "epoch")) -> DataFrame:
    return df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def average_reference(df: DataFrame, keys: Sequence[str] = ("epoch", "sample")) -> DataFrame:
    """Takes the mean over channels off each sample."""
    return df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def quietest(df: DataFrame, keep: int, keys: Sequence[str] = ()) -> DataFrame:
    """The `keep` epochs of least variance over all channels and samples; all, if there are fewer."""
    var = df.groupBy(*keys, "epoch").agg(F.var_samp("value").alias("variance"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(r9(F.col("variance")), "epoch"))
    return var.withColumn("rank", rank).filter(F.col("rank") <= keep)


def reject_epochs(df: DataFrame, most: float, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Drops epochs whose variance is above `most` on any channel."""
    bad = df.groupBy(*keys, "epoch").agg(F.var_samp("value").alias("v")).filter(F.col("v") > most).select("epoch").distinct()
    return df.join(bad, "epoch", "left_anti")


def fourier(df: DataFrame, n: int, bins: int, keys: Sequence[str] = ("channel", "epoch")) -> DataFrame:
    """re, im and power for each of the first bins, of samples 0 to n - 1. Sums are additive, so missing samples count 0."""
    angle = F.lit(-2 * math.pi / n) * F.col("bin") * F.col("sample")
    spread = df.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    out = spread.groupBy(*keys, "bin").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))
    return out.withColumn("power", (F.col("re") ** 2 + F.col("im") ** 2) / n)


def in_bands(spectrum: DataFrame, bands: DataFrame, freq: str = "bin") -> DataFrame:
    """Rows of each band's bins, both edges included. Bands are a few rows and broadcast."""
    return spectrum.join(F.broadcast(bands), F.col(freq).between(F.col("lo"), F.col("hi")))


def nearest_bin(spectrum: DataFrame, edges: DataFrame, keys: Sequence[str], freq: str = "bin") -> DataFrame:
    """keys, edge and the spectrum's frequency closest to it, the lower of equals; edges(keys, edge) and distinct frequencies are few."""
    both = spectrum.select(freq).distinct().join(F.broadcast(edges))
    return both.groupBy(*keys, "edge").agg(F.min_by(freq, F.struct(r9(F.abs(F.col(freq) - F.col("edge"))), freq)).alias(freq)).select(*keys, F.col("edge").cast("double").alias("edge"), freq)


def unit_scale(df: DataFrame, factor: float = 1e6) -> DataFrame:
    """Volts to microvolts."""
    return df.withColumn("value", F.col("value") * factor)


def band_peak(spectrum: DataFrame, bands: DataFrame, value: str, unit: Sequence[str], keys: Sequence[str] = (), freq: str = "bin") -> DataFrame:
    """Each unit's value at the bin where the mean over units peaks in the band; the first of equals; NaN takes no part."""
    rows = in_bands(spectrum, bands, freq).filter(~F.isnan(value))
    mean = rows.groupBy(*keys, "band", freq).agg(r9(F.avg(value)).alias("m"))
    peak = mean.groupBy(*keys, "band").agg(F.max_by(freq, F.struct("m", (-F.col(freq)).alias("f"))).alias(freq))
    return rows.join(peak, [*keys, "band", freq]).select(*keys, "band", *unit, freq, value)


def share(df: DataFrame, value: str, over: Sequence[str], out: str = "rel") -> DataFrame:
    return df.withColumn(out, F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*over)), F.lit(0.0)))


def cross_spectrum(four: DataFrame, keys: Sequence[str] = ("epoch", "bin")) -> DataFrame:
    """re and im of every channel pair ch_i < ch_j in each epoch and bin. A task holds a few epochs' channels, not pairs of the table."""
    a = four.select(*keys, F.col("channel").alias("ch_i"), F.col("re").alias("re_i"), F.col("im").alias("im_i"))
    b = four.select(*keys, F.col("channel").alias("ch_j"), F.col("re").alias("re_j"), F.col("im").alias("im_j"))
    both = a.join(b, list(keys)).filter(F.col("ch_i") < F.col("ch_j"))
    return both.select(*keys, "ch_i", "ch_j", (F.col("re_i") * F.col("re_j") + F.col("im_i") * F.col("im_j")).alias("re"), (F.col("im_i") * F.col("re_j") - F.col("re_i") * F.col("im_j")).alias("im"))


def debiased_wpli(csd: DataFrame, keys: Sequence[str] = ("bin",)) -> DataFrame:
    """Squared sum of the imaginary parts against the sum of their sizes, both without the epochs' own squares."""
    sums = csd.groupBy(*keys, "ch_i", "ch_j").agg(F.sum("im").alias("s"), F.sum(F.abs("im")).alias("a"), F.sum(F.col("im") ** 2).alias("q"))
    return sums.select(*keys, "ch_i", "ch_j", ((F.col("s") ** 2 - F.col("q")) / F.nullif(F.col("a") ** 2 - F.col("q"), F.lit(0.0))).alias("w"))


def channel_mean(pairs: DataFrame, value: str = "w", keys: Sequence[str] = ("bin",)) -> DataFrame:
    """Mean over the pairs that a channel is part of."""
    both = pairs.select(*keys, F.explode(F.array("ch_i", "ch_j")).alias("channel"), value)
    return both.groupBy(*keys, "channel").agg(F.avg(value).alias(value))


def symbols(df: DataFrame, tau: int, keys: Sequence[str] = ("channel", "epoch")) -> DataFrame:
    """The order pattern (0 to 5) of three samples tau apart; ties by position."""
    w = Window.partitionBy(*keys).orderBy("sample")
    a, b, c = F.col("value"), F.lead("value", tau).over(w), F.lead("value", 2 * tau).over(w)
    out = df.select(*keys, "sample", a.alias("a"), b.alias("b"), c.alias("c")).filter("c is not null")
    code = F.expr("case when a <= b and b <= c then 0 when a <= c and c < b then 1 when b < a and a <= c then 2 when c < a and a <= b then 3 when b <= c and c < a then 4 else 5 end")
    return out.select(*keys, "sample", code.alias("symbol"))


def weighted_symbolic_information(sym: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean over epochs of the weighted mutual information of two channels' symbols, in units of log 6, not below 0.

    Equal symbols and mirrored ones (a pattern and its reversed signs) have weight 0, as they can come from one source.
    """
    a = sym.select(*keys, "sample", F.col("channel").alias("ch_i"), F.col("symbol").alias("x"))
    b = sym.select(*keys, "sample", F.col("channel").alias("ch_j"), F.col("symbol").alias("y"))
    joint = a.join(b, [*keys, "sample"]).filter("ch_i < ch_j").groupBy(*keys, "ch_i", "ch_j", "x", "y").count()
    pair = [*keys, "ch_i", "ch_j"]
    total = F.sum("count").over(Window.partitionBy(*pair))
    px, py = F.sum("count").over(Window.partitionBy(*pair, "x")), F.sum("count").over(Window.partitionBy(*pair, "y"))
    mirror = F.get(F.array(*map(F.lit, (5, 4, 3, 2, 1, 0))), F.col("x"))
    weight = F.when((F.col("x") == F.col("y")) | (F.col("y") == mirror), 0.0).otherwise(1.0)
    terms = joint.withColumn("term", weight * F.col("count") / total * F.log(F.col("count") * total / (px * py)))
    each = terms.groupBy(*pair).agg((F.sum("term") / math.log(6)).alias("w"))
    return each.groupBy("ch_i", "ch_j").agg(F.greatest(F.avg("w"), F.lit(0.0)).alias("w"))


def tapers(n: int, bandwidth: float, k: int | None = None) -> np.ndarray:
    """The k most concentrated discrete prolate sequences of time-bandwidth product `bandwidth`, by the tridiagonal eigenproblem."""
    k = k or max(1, int(2 * bandwidth) - 1)
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * bandwidth / n)
    off = i[1:] * (n - i[1:]) / 2
    vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))[1]
    return vectors[:, ::-1][:, :k].T


def multitaper(df: DataFrame, rate: float, n: int, smoothing: float = 0.3, lo: float = 0.5, hi: float = 45.0, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Mean power over epochs and tapers for each key and frequency; one task holds one epoch of one key at a time."""
    own = tapers(n, max(1.0, smoothing * n / rate))
    size = 1 << (n - 1).bit_length()
    freqs = np.fft.rfftfreq(size, 1 / rate)
    pick = (freqs >= lo) & (freqs <= hi)
    kinds = {f.name: f.dataType for f in df.schema}

    def power(p: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        at = p["sample"].to_numpy()
        x[at[at < n]] = p["value"].to_numpy()[at < n]
        got = (np.abs(np.fft.rfft(own * x, size)) ** 2).mean(axis=0)[pick] * 2 / rate
        return pd.DataFrame({**{k: [p[k].iloc[0]] * int(pick.sum()) for k in keys}, "freq": freqs[pick], "power": got})

    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", freq double, power double"
    return df.groupBy(*keys, "epoch").applyInPandas(power, schema).groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def sinc_filter(cut: float, rate: float, high: bool, length: int = 0) -> np.ndarray:
    """Hamming-windowed sinc of odd length that passes below (or above) the cut."""
    length = length or int(3.3 * rate / max(cut * 0.25, 2.0)) | 1
    t = np.arange(length) - length // 2
    h = np.sinc(2 * cut / rate * t) * np.hamming(length)
    h /= h.sum()
    return (t == 0) - h if high else h


def polyphase(at: np.ndarray, x: np.ndarray, up: int, down: int, half: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Samples (ascending numbers, values) at up/down times their rate, and their new numbers.

    The Kaiser-windowed sinc of `half` periods on either side, at the lower of both rates, is split into its `up` phases,
    each of gain 1; an output is one phase's product with the samples around it, so nothing is computed that is then
    dropped. Gaps are filled linearly, and the first and last values are held beyond the ends.
    """
    wide = max(up, down)
    reach = -(-half * wide // up)
    offset = np.arange(up)[:, None] + up * np.arange(-reach, reach + 1)[None]
    bank = np.sinc(offset / wide) * np.i0(10.0 * np.sqrt(np.maximum(0.0, 1 - (offset / (half * wide)) ** 2))) * (np.abs(offset) <= half * wide)
    bank /= bank.sum(axis=1, keepdims=True)
    whole = np.interp(np.arange(at[0], at[-1] + 1), at, x)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(whole, reach, mode="edge"), 2 * reach + 1)
    new = np.arange(-(-at[0] * up // down), at[-1] * up // down + 1)
    first, phase = new * down // up - at[0], new * down % up
    out = np.empty(len(new))
    for p in np.unique(phase):
        own = phase == p
        out[own] = around[first[own]] @ bank[p, ::-1]
    return new, out


def filtered(df: DataFrame, rate: float, low_pass: float | None = 45.0, high_pass: float | None = 0.5, resample_to: float | None = None, keys: Sequence[str] = ("channel",), block: int = 1 << 16) -> DataFrame:
    """Resamples, then low-passes, then high-passes each channel's (sample, value); a rate below the wanted one is refused.

    A task holds one block of a channel and, on either side, the samples that the filters reach. Samples keep their
    numbers, counted from 0 at the new rate; missing ones are passed over, or interpolated where the rate changes. A
    channel's first and last values are held beyond its ends.
    """
    if resample_to and rate < resample_to:
        raise ValueError(f"sampling rate {rate} is below {resample_to}")
    to = resample_to or rate
    ratio = Fraction(to / rate).limit_denominator(10_000)
    stages = [sinc_filter(cut, to, high) for cut, high in ((low_pass, False), (high_pass, True)) if cut and cut < to / 2]
    reach = math.ceil(sum(len(h) // 2 + 1 for h in stages) * rate / to) + (-(-32 * max(ratio.as_integer_ratio()) // ratio.numerator) if to < rate else 0) + 1
    block = max(block, reach)
    kinds = {f.name: f.dataType for f in df.schema}

    def smooth(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, len(h) // 2, mode="edge"), h, "valid")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sample")
        at, x, k = np.asarray(t["sample"], np.int64), np.asarray(t["value"], float), t["_block"][0].as_py()
        if to < rate:
            at, x = polyphase(at, x, ratio.numerator, ratio.denominator)
        for h in stages if len(x) else ():
            x = smooth(x, h)
        own = (at * rate / to >= k * block) & (at * rate / to < (k + 1) * block)
        return pa.table({**{c: pa.repeat(t[c][0], int(own.sum())) for c in keys}, "sample": at[own], "value": x[own]})

    return dealt(df, keys, block, reach).groupBy(*keys, "_block").applyInArrow(run, ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", sample long, value double")


def dealt(df: DataFrame, keys: Sequence[str], block: int, reach: int) -> DataFrame:
    """Samples with the block they lie in, and once more with a neighbouring block that reaches them."""
    number = lambda shift: F.floor((F.col("sample") + shift) / block)
    return df.select(*keys, "sample", "value", F.explode(F.array_distinct(F.array(number(-reach), number(0), number(reach)))).alias("_block"))


def remove_harmonic(df: DataFrame, rate: float, line: float = 50.0, seconds: float = 4.0, smoothing: float = 2.0, p: float = 0.05, keys: Sequence[str] = ("channel",), block: int = 1 << 16) -> DataFrame:
    """Takes a line frequency off each channel's (sample, value) where a harmonic F test finds it.

    In windows of `seconds`, half overlapping, the tapers' transforms at the line give a sinusoid's amplitude and phase,
    and what they leave unexplained its significance: with k tapers, F has 2 and 2k - 2 degrees of freedom. Sinusoids below
    that `p` are added up with triangular weights and taken off; elsewhere the signal stays as it is. Amplitude and phase may thus drift from window to window. Windows that hold fewer than half
    their samples tell nothing. A task holds one block of a channel and a window on either side; nulls are dropped.
    """
    n = max(8, int(round(seconds * rate)) // 2 * 2)
    step, block = n // 2, max(block // n, 2) * n
    own = tapers(n, max(1.5, smoothing * n / rate))
    limit = max(1e-300, p) if len(own) > 1 else 0.0
    weight = 1 - np.abs((np.arange(n) + 0.5) / step - 1)
    kinds = {f.name: f.dataType for f in df.schema}
    turn = 2 * math.pi * line / rate

    def sinusoid(x: np.ndarray, held: np.ndarray, start: int) -> np.ndarray | None:
        wave = np.exp(-1j * turn * np.arange(start, start + n))
        j, u = own @ (x * wave), own @ held.astype(float)
        power = (u * u).sum()
        if held.sum() < step or power < 1e-12:
            return None
        c = (u * j).sum() / power
        rest = (np.abs(j - c * u) ** 2).sum()
        f = (len(own) - 1) * abs(c) ** 2 * power / rest if rest > 0 else math.inf
        chance = (1 + f / (len(own) - 1)) ** -(len(own) - 1) if len(own) > 1 else 1.0
        return 2 * (c * wave.conj()).real if chance < limit else None

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sample")
        at, x, k = np.asarray(t["sample"], np.int64), np.asarray(t["value"], float), t["_block"][0].as_py()
        first = int(at[0]) // step * step - step
        size = (int(at[-1]) - first) // step * step + 2 * n
        flat, held = np.zeros(size), np.zeros(size, bool)
        flat[at - first], held[at - first] = x, True
        mean = flat[held].mean()
        flat[held] -= mean  # a recording's offset would leak into the line
        taken, told = np.zeros(size), np.zeros(size)
        for start in range(0, size - n + 1, step):
            some = slice(start, start + n)
            wave = sinusoid(flat[some], held[some], first + start)
            if held[some].sum() >= step:
                told[some] += weight
                if wave is not None:
                    taken[some] += weight * wave
        out = x - np.divide(taken, told, out=np.zeros(size), where=told > 0)[at - first]
        mine = (at >= k * block) & (at < (k + 1) * block)
        return pa.table({**{c: pa.repeat(t[c][0], int(mine.sum())) for c in keys}, "sample": at[mine], "value": out[mine]})

    rows = df.filter("value is not null and sample is not null").withColumn("sample", F.col("sample").cast("long"))
    return dealt(rows, keys, block, 2 * n).groupBy(*keys, "_block").applyInArrow(run, ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", sample long, value double")


def remove_line_noise(df: DataFrame, rate: float, line: float = 50.0, keys: Sequence[str] = ("channel", "epoch")) -> DataFrame:
    """Takes off the line frequency's least-squares sine and cosine, by sums over each epoch."""
    w = Window.partitionBy(*keys)
    angle = F.lit(2 * math.pi * line / rate) * F.col("sample")
    c, s = F.cos(angle), F.sin(angle)
    cc, ss, cs = F.sum(c * c).over(w), F.sum(s * s).over(w), F.sum(c * s).over(w)
    xc, xs = F.sum(F.col("value") * c).over(w), F.sum(F.col("value") * s).over(w)
    det = cc * ss - cs * cs
    det = F.when(det > 1e-9 * (cc + ss) ** 2, det)  # too few samples to tell sine from cosine: nothing is taken off
    return df.withColumn("value", F.col("value") - F.coalesce(((xc * ss - xs * cs) * c + (xs * cc - xc * cs) * s) / det, F.lit(0.0)))


def surface_laplacian(df: DataFrame, channels: pd.DataFrame, keys: Sequence[str] = ("epoch",), order: int = 4, terms: int = 50, smooth: float = 1e-5) -> DataFrame:
    """Current source density of (keys, channel, sample, value) by spherical splines; channels (channel, x, y, z) on the unit sphere. One task holds one epoch; channels without a place are left out."""
    place = channels.set_index("channel")[["x", "y", "z"]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    n = np.arange(1, terms + 1)
    g_terms, h_terms = (2 * n + 1) / (n * (n + 1.0)) ** order, (2 * n + 1) / (n * (n + 1.0)) ** (order - 1)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        wide = p[p["channel"].isin(place.index)].pivot_table(index="channel", columns="sample", values="value").dropna(axis=1)
        at = place.loc[wide.index].to_numpy()
        cosine = np.clip(at @ at.T, -1, 1)
        g, h = (np.polynomial.legendre.legval(cosine, np.append(0.0, c)) / (4 * math.pi) for c in (g_terms, h_terms))
        inverse = np.linalg.inv(g + smooth * np.eye(len(at)))
        v = wide.to_numpy()
        c = inverse @ v
        c -= np.outer(inverse.sum(axis=1) / inverse.sum(), c.sum(axis=0))
        out = pd.DataFrame(h @ c, index=wide.index, columns=wide.columns).stack().rename("value").reset_index()
        return out.assign(**{k: p[k].iloc[0] for k in keys})[[*keys, "channel", "sample", "value"]]

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", channel string, sample {kinds['sample']}, value double")
