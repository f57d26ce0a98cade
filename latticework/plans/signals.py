"""Signal queries over `events`: channel event_type, epoch day, sample hour, value the hour's mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import decibel
from latticework.operators import conditions as C
from latticework.operators import signal as S
from latticework.operators import spectra as P
from latticework.session import table
from latticework.streaming.windows import epoch_windows

#: Bands over the daily cycles of an hourly signal.
BANDS = [(1, 1, 2), (2, 3, 5), (3, 6, 11)]


def samples(spark, d) -> DataFrame:
    ev = table(spark, d, "events").select("event_type", "ts", "value")
    return ev.groupBy(F.col("event_type").alias("channel"), F.dayofyear("ts").alias("epoch"), F.hour("ts").alias("sample")).agg(F.avg("value").alias("value"))


def bands(spark) -> DataFrame:
    return spark.createDataFrame(BANDS, "band int, lo int, hi int")


def out(df, keys, *values, digits=9):
    nudge = 0.0 if digits == 9 else 1e-8  # large values are rounded sooner; ties, common there, must fall alike whatever the order of summation
    return df.select(*keys, *[F.round(F.col(v).cast("double") + nudge, digits).alias(v) for v in values])


def four(spark, d, bins=11):
    return S.fourier(samples(spark, d), 24, bins)


def spectrum(spark, d):
    return four(spark, d).groupBy("channel", "bin").agg(F.avg("power").alias("power"))


def wpli(spark, d):
    """Of plain, untapered epochs, by blocks of channel pairs."""
    names = P.channel_names(table(spark, d, "events").select(F.col("event_type").alias("channel")))
    blocks = P.cross_blocks(samples(spark, d), names, 24.0, 24, lo=1.0, hi=11.0, keys=(), windows=np.ones((1, 24)))
    return P.block_wpli(blocks, names, ()).withColumn("bin", F.col("freq").cast("int"))


def peak_power(spark, d):
    rows = S.band_peak(spectrum(spark, d), bands(spark), "power", ["channel"])
    return out(S.share(rows, "power", ["channel"]), ["band", "channel", "bin"], "power", "rel")


def mean_power(spark, d):
    rows = S.in_bands(spectrum(spark, d), bands(spark)).groupBy("band", "channel").agg(F.avg("power").alias("power"))
    return out(S.share(rows, "power", ["channel"]), ["band", "channel"], "power", "rel")


def windows(spark, d):
    w = epoch_windows(table(spark, d, "events").select("ts", "event_type", "value"), "ts", "value", ["event_type"], "6 hours")
    return out(w.withColumn("start", F.col("start").cast("string")), ["event_type", "start", "n"], "mean", "variance")


def multitaper(spark, d):
    return out(S.multitaper(samples(spark, d), 24.0, 24, smoothing=2.0, lo=1.0, hi=11.0), ["channel"], "freq", "power", digits=5)


#: The time constants, of which those are used whose three samples fit an epoch.
TAUS = (32, 16, 8, 4, 2)


def wsmi(spark, d):
    """At every time constant that fits the 24 samples of an epoch."""
    own = [S.weighted_symbolic_information(S.symbols(samples(spark, d), tau)).withColumn("tau", F.lit(tau)) for tau in TAUS if 2 * tau < 24]
    both = own[0]
    for x in own[1:]:
        both = both.unionByName(x)
    return out(both, ["tau", "ch_i", "ch_j"], "w")


def permuted(spark, d):
    """Odd against even days, in the second band; a last day without a partner is left out."""
    csd = S.cross_spectrum(four(spark, d)).filter("bin between 3 and 5")
    days = csd.agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    paired = csd.crossJoin(days).filter("epoch < first + (last - first + 1) div 2 * 2").drop("first", "last")
    return C.permuted_wpli(paired, paired.select("epoch", F.pmod("epoch", F.lit(2)).alias("condition")))


def condition_difference(spark, d):
    return out(permuted(spark, d).filter("perm = 0"), ["ch_i", "ch_j"], "diff")


def nearest(spark, d):
    """The bin closest to each band's edges."""
    edges = bands(spark).select("band", F.explode(F.array(F.col("lo") - 0.25, F.col("hi") + 0.25)).alias("edge"))
    return S.nearest_bin(spectrum(spark, d), edges, ["band"])


QUERIES = {
    "dwpli_condition_difference": condition_difference,
    "dwpli_permutation": lambda s, d: out(C.one_sided(permuted(s, d)), ["ch_i", "ch_j"], "diff", "p"),
    "network_permutation": lambda s, d: out(C.network_statistic(permuted(s, d), alpha=1.0), ["component", "nodes"], "intensity", "p"),
    "nearest_bin": nearest,
    "unit_scale": lambda s, d: out(S.unit_scale(samples(s, d)), ["channel", "epoch", "sample"], "value", digits=2),
    "epoch_baseline": lambda s, d: out(S.remove_baseline(samples(s, d)), ["channel", "epoch", "sample"], "value"),
    "common_average_reference": lambda s, d: out(S.average_reference(samples(s, d)), ["channel", "epoch", "sample"], "value"),
    "quietest_epochs": lambda s, d: out(S.quietest(samples(s, d), 10), ["epoch", "rank"], "variance"),
    "complete_epochs": lambda s, d: S.complete_epochs(samples(s, d), 24).groupBy("channel").agg(F.countDistinct("epoch").alias("epochs")),
    "reject_epochs": lambda s, d: S.reject_epochs(samples(s, d), 1500.0).groupBy("epoch").agg(F.count("*").alias("n")),
    "dft_power": lambda s, d: out(four(s, d), ["channel", "epoch", "bin"], "re", "im", "power", digits=5),
    "power_decibel": lambda s, d: out(spectrum(s, d).withColumn("db", decibel(F.col("power"))), ["channel", "bin"], "db"),
    "band_peak_power": peak_power,
    "band_mean_power": mean_power,
    "cross_spectrum": lambda s, d: out(S.cross_spectrum(four(s, d)), ["epoch", "bin", "ch_i", "ch_j"], "re", "im", digits=5),
    "debiased_wpli": lambda s, d: out(wpli(s, d), ["bin", "ch_i", "ch_j"], "w"),
    "band_peak_wpli": lambda s, d: out(S.band_peak(wpli(s, d), bands(s), "w", ["ch_i", "ch_j"]), ["band", "ch_i", "ch_j", "bin"], "w"),
    "channel_mean_wpli": lambda s, d: out(S.channel_mean(wpli(s, d)), ["bin", "channel"], "w"),
    "mean_wpli_spectrum": lambda s, d: out(S.channel_mean(wpli(s, d)).groupBy("bin").agg(F.avg("w").alias("w")), ["bin"], "w"),
    "wsmi": wsmi,
    "multitaper_power": multitaper,
    "filtered_signal": lambda s, d: out(S.filtered(samples(s, d).withColumn("sample", (F.col("epoch") * 24 + F.col("sample")).cast("long")).drop("epoch"), 24.0, 6.0, 0.5), ["channel", "sample"], "value", digits=5),
    "line_noise_removed": lambda s, d: out(S.remove_line_noise(samples(s, d), 24.0, 6.0), ["channel", "epoch", "sample"], "value", digits=5),
    "epoch_window": windows,
}

_S = "s AS (SELECT event_type AS channel, CAST(dayofyear(ts) AS INT) AS epoch, CAST(hour(ts) AS INT) AS sample, avg(value) AS value FROM events GROUP BY ALL)"
_F = _S + ", f AS (SELECT channel, epoch, bin, sum(value*cos(-2*pi()/24*bin*sample)) AS re, sum(value*sin(-2*pi()/24*bin*sample)) AS im, (sum(value*cos(-2*pi()/24*bin*sample))**2 + sum(value*sin(-2*pi()/24*bin*sample))**2)/24 AS power FROM s, (SELECT CAST(unnest(range(1,12)) AS INT) AS bin) GROUP BY ALL)"
_P = _F + ", p AS (SELECT channel, bin, avg(power) AS power FROM f GROUP BY ALL), bands AS (SELECT * FROM (VALUES (1,1,2),(2,3,5),(3,6,11)) t(band,lo,hi))"
_C = _F + ", c AS (SELECT a.epoch, a.bin, a.channel AS ch_i, b.channel AS ch_j, a.re*b.re+a.im*b.im AS re, a.im*b.re-a.re*b.im AS im FROM f a JOIN f b ON a.epoch=b.epoch AND a.bin=b.bin AND a.channel<b.channel)"
_W = _C + ", w AS (SELECT bin, ch_i, ch_j, (sum(im)**2-sum(im**2))/nullif(sum(abs(im))**2-sum(im**2),0) AS w FROM c GROUP BY ALL), bands AS (SELECT * FROM (VALUES (1,1,2),(2,3,5),(3,6,11)) t(band,lo,hi))"
_M = ", m AS (SELECT bin, channel, avg(w) AS w FROM (SELECT bin, ch_i AS channel, w FROM w UNION ALL SELECT bin, ch_j, w FROM w) GROUP BY ALL)"
_CASE = "CASE WHEN value<=b AND b<=c THEN 0 WHEN value<=c AND c<b THEN 1 WHEN b<value AND value<=c THEN 2 WHEN c<value AND value<=b THEN 3 WHEN b<=c AND c<value THEN 4 ELSE 5 END"
_PEAK = "k AS (SELECT band, bin FROM (SELECT band, bin, row_number() OVER (PARTITION BY band ORDER BY round(avg({v}),9) DESC, bin) AS r FROM {t} JOIN bands ON bin BETWEEN lo AND hi GROUP BY band, bin) WHERE r=1)"

_WSMI = "SELECT * FROM (WITH " + _S + ", y AS (SELECT *, lead(value,{tau}) OVER q AS b, lead(value,{two}) OVER q AS c FROM s WINDOW q AS (PARTITION BY channel, epoch ORDER BY sample)), z AS (SELECT channel, epoch, sample, " + _CASE + " AS x FROM y WHERE c IS NOT NULL), j AS (SELECT a.epoch, a.channel AS ch_i, b.channel AS ch_j, a.x, b.x AS y, CAST(count(*) AS DOUBLE) AS n FROM z a JOIN z b ON a.epoch=b.epoch AND a.sample=b.sample AND a.channel<b.channel GROUP BY ALL), t AS (SELECT epoch, ch_i, ch_j, CASE WHEN x=y OR y=5-x THEN 0 ELSE 1 END*n/sum(n) OVER g*ln(n*sum(n) OVER g/(sum(n) OVER (PARTITION BY epoch,ch_i,ch_j,x)*sum(n) OVER (PARTITION BY epoch,ch_i,ch_j,y))) AS term FROM j WINDOW g AS (PARTITION BY epoch, ch_i, ch_j)), e AS (SELECT epoch, ch_i, ch_j, sum(term)/ln(6) AS w FROM t GROUP BY ALL) SELECT {tau} AS tau, ch_i, ch_j, round(greatest(avg(w),0.0),9) AS w FROM e GROUP BY ALL)"

_DIFF = _S + ", u AS (SELECT channel, epoch, bin, sum(value*cos(-2*pi()/24*bin*sample)) AS re, sum(value*sin(-2*pi()/24*bin*sample)) AS im FROM s, (SELECT CAST(unnest(range(3,6)) AS INT) AS bin) GROUP BY ALL), o AS (SELECT a.epoch, a.bin, a.channel AS ch_i, b.channel AS ch_j, a.im*b.re-a.re*b.im AS im FROM u a JOIN u b ON a.epoch=b.epoch AND a.bin=b.bin AND a.channel<b.channel), g AS (SELECT *, min(epoch) OVER () AS lo, max(epoch) OVER () AS hi FROM o), h AS (SELECT bin, ch_i, ch_j, epoch%2 AS side, (sum(im)**2-sum(im**2))/nullif(sum(abs(im))**2-sum(im**2),0) AS w FROM g WHERE epoch<lo+(hi-lo+1)//2*2 GROUP BY ALL), m AS (SELECT side, bin, row_number() OVER (PARTITION BY side ORDER BY round(avg(w),9) DESC, bin) AS r FROM h GROUP BY side, bin), x AS (SELECT h.* FROM h JOIN m ON h.side=m.side AND h.bin=m.bin WHERE r=1)"



def rows_sql(columns: str, rows) -> str:
    """Numbers as a table of VALUES."""
    return "(VALUES " + ",".join("(" + ",".join(f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") t({columns})"


def taps_sql(cut: float, high: bool) -> str:
    return rows_sql("k,h", [(k, float(h)) for k, h in enumerate(S.sinc_filter(cut, 24.0, high))])


#: Tapers of two cycles a day, padded to 32 samples.
_TAPERS = rows_sql("k,sample,taper", [(k, t, float(x)) for k, row in enumerate(S.tapers(24, 2.0)) for t, x in enumerate(row)])
#: Each value with its neighbours in order, the first and last held beyond the ends, times the filter's taps.
_SMOOTH = "SELECT x.channel, x.sample, x.n, x.size, sum(y.value*h) AS value FROM {x} x, {taps} JOIN {x} y ON y.channel=x.channel AND y.n=least(greatest(x.n+k-{half},1),x.size) GROUP BY ALL"

ORACLE = {
    "multitaper_power": f"WITH {_S}, tp AS (SELECT * FROM {_TAPERS}), b AS (SELECT freq FROM (SELECT unnest(range(0,17))*24/32.0::DOUBLE AS freq) WHERE freq BETWEEN 1 AND 11), x AS (SELECT channel, epoch, k, freq, sum(value*taper*cos(-2*pi()*freq*sample/24)) AS re, sum(value*taper*sin(-2*pi()*freq*sample/24)) AS im FROM s JOIN tp USING (sample), b GROUP BY ALL) SELECT channel, freq, round(avg(p)+1e-8,5) AS power FROM (SELECT channel, epoch, freq, avg(re*re+im*im)*2/24 AS p FROM x GROUP BY ALL) GROUP BY ALL",
    "filtered_signal": f"WITH {_S}, a AS (SELECT channel, CAST(epoch*24+sample AS BIGINT) AS sample, value, row_number() OVER (PARTITION BY channel ORDER BY epoch*24+sample) AS n, count(*) OVER (PARTITION BY channel) AS size FROM s), l AS ({_SMOOTH.format(x='a', taps=taps_sql(6.0, False), half=len(S.sinc_filter(6.0, 24.0, False)) // 2)}), h AS ({_SMOOTH.format(x='l', taps=taps_sql(0.5, True), half=len(S.sinc_filter(0.5, 24.0, True)) // 2)}) SELECT channel, sample, round(value+1e-8,5) AS value FROM h",
    "dwpli_condition_difference": f"WITH {_DIFF} SELECT a.ch_i, a.ch_j, round(a.w-b.w,9) AS diff FROM x a JOIN x b ON a.ch_i=b.ch_i AND a.ch_j=b.ch_j WHERE a.side=0 AND b.side=1",
    "nearest_bin": "WITH ed AS (SELECT band, unnest([lo-0.25, hi+0.25]) AS edge FROM (VALUES (1,1,2),(2,3,5),(3,6,11)) t(band,lo,hi)) SELECT band, CAST(edge AS DOUBLE) AS edge, CAST((SELECT arg_min(k, abs(k-edge)*1000+k) FROM (SELECT unnest(range(1,12)) AS k)) AS INT) AS bin FROM ed",
    "unit_scale": f"WITH {_S} SELECT channel, epoch, sample, round(value*1000000+1e-8,2) AS value FROM s",
    "epoch_baseline": f"WITH {_S} SELECT channel, epoch, sample, round(value-avg(value) OVER (PARTITION BY channel, epoch),9) AS value FROM s",
    "common_average_reference": f"WITH {_S} SELECT channel, epoch, sample, round(value-avg(value) OVER (PARTITION BY epoch, sample),9) AS value FROM s",
    "quietest_epochs": f"WITH {_S}, v AS (SELECT epoch, var_samp(value) AS variance FROM s GROUP BY 1) SELECT * FROM (SELECT epoch, CAST(row_number() OVER (ORDER BY round(variance,9), epoch) AS INT) AS rank, round(variance,9) AS variance FROM v) WHERE rank<=10",
    "complete_epochs": f"WITH {_S}, k AS (SELECT channel, epoch FROM s GROUP BY ALL HAVING count(*)>=24) SELECT channel, count(DISTINCT epoch) AS epochs FROM k GROUP BY 1",
    "reject_epochs": f"WITH {_S} SELECT epoch, count(*) AS n FROM s WHERE epoch NOT IN (SELECT epoch FROM s GROUP BY channel, epoch HAVING var_samp(value)>1500) GROUP BY 1",
    "dft_power": f"WITH {_F} SELECT channel, epoch, bin, round(re+1e-8,5) AS re, round(im+1e-8,5) AS im, round(power+1e-8,5) AS power FROM f",
    "power_decibel": f"WITH {_P} SELECT channel, bin, round(10*log10(power),9) AS db FROM p",
    "band_peak_power": f"WITH {_P}, {_PEAK.format(v='power', t='p')} SELECT band, channel, bin, round(power,9) AS power, round(power/sum(power) OVER (PARTITION BY channel),9) AS rel FROM p JOIN k USING (bin)",
    "band_mean_power": f"WITH {_P}, m AS (SELECT band, channel, avg(power) AS power FROM p JOIN bands ON bin BETWEEN lo AND hi GROUP BY ALL) SELECT band, channel, round(power,9) AS power, round(power/sum(power) OVER (PARTITION BY channel),9) AS rel FROM m",
    "cross_spectrum": f"WITH {_C} SELECT epoch, bin, ch_i, ch_j, round(re+1e-8,5) AS re, round(im+1e-8,5) AS im FROM c",
    "debiased_wpli": f"WITH {_W} SELECT bin, ch_i, ch_j, round(w,9) AS w FROM w",
    "band_peak_wpli": f"WITH {_W}, {_PEAK.format(v='w', t='w')} SELECT band, ch_i, ch_j, bin, round(w,9) AS w FROM w JOIN k USING (bin)",
    "channel_mean_wpli": f"WITH {_W}{_M} SELECT bin, channel, round(w,9) AS w FROM m",
    "mean_wpli_spectrum": f"WITH {_W}{_M} SELECT bin, round(avg(w),9) AS w FROM m GROUP BY 1",
    "wsmi": " UNION ALL ".join(_WSMI.format(tau=t, two=2 * t) for t in TAUS if 2 * t < 24),
    "line_noise_removed": f"WITH {_S}, q AS (SELECT *, cos(pi()/2*sample) AS c, sin(pi()/2*sample) AS d FROM s), g AS (SELECT *, sum(c*c) OVER k AS cc, sum(d*d) OVER k AS dd, sum(c*d) OVER k AS cd, sum(value*c) OVER k AS vc, sum(value*d) OVER k AS vd FROM q WINDOW k AS (PARTITION BY channel, epoch)) SELECT channel, epoch, sample, round(value+1e-8-CASE WHEN cc*dd-cd*cd>1e-9*(cc+dd)**2 THEN ((vc*dd-vd*cd)*c+(vd*cc-vc*cd)*d)/(cc*dd-cd*cd) ELSE 0 END,5) AS value FROM g",
    "epoch_window": "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value),9) AS mean, round(var_samp(value),9) AS variance FROM events GROUP BY ALL",
}
