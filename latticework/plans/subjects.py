"""Queries over subjects' recordings in `events`: subject from user_id, channel event_type, epoch the date, sample the hour, value the hour's mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import signal as S
from latticework.operators import spectra as P
from latticework.operators import symbolic as Y
from latticework.operators.reference import time_constant_hz
from latticework.plans.signals import BANDS, TAUS, bands, out
from latticework.session import table

#: Users are taken together as so many subjects, so that a subject's days hold enough hours.
SUBJECTS = 4
#: Samples a day, and the tapers' half bandwidth, lowest and highest frequency in cycles a day.
N, SMOOTHING, LO, HI = 24, 2.0, 1.0, 11.0


def recordings(spark, d, subjects: int = SUBJECTS) -> DataFrame:
    ev = table(spark, d, "events").filter("user_id is not null and ts is not null").select("user_id", "event_type", "ts", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    keys = F.pmod("user_id", F.lit(subjects)).cast("int").alias("subject"), F.col("event_type").alias("channel"), day.alias("epoch"), F.hour("ts").alias("sample")
    return ev.groupBy(*keys).agg(F.avg("value").alias("value"))


def blocks(spark, d) -> tuple[DataFrame, list[str]]:
    names = P.channel_names(table(spark, d, "events").select(F.col("event_type").alias("channel")))
    return P.cross_blocks(recordings(spark, d), names, float(N), N, SMOOTHING, LO, HI), names


def wpli(spark, d) -> DataFrame:
    return P.block_wpli(*blocks(spark, d))


def band_wpli(spark, d) -> DataFrame:
    """Each pair's connectivity at the frequency where the mean over a subject's pairs peaks in the band."""
    return out(S.band_peak(wpli(spark, d), bands(spark), "w", ["ch_i", "ch_j"], ["subject"], freq="freq"), ["subject", "band", "ch_i", "ch_j"], "freq", "w")


def channel_wpli(spark, d) -> DataFrame:
    return out(S.channel_mean(wpli(spark, d), keys=["subject", "freq"]), ["subject", "channel"], "freq", "w")


def power(spark, d) -> DataFrame:
    return out(P.block_power(*blocks(spark, d)), ["subject", "channel"], "freq", "power", digits=5)


def numbered(spark, d) -> DataFrame:
    """Recordings with samples numbered through."""
    return recordings(spark, d).select("subject", "channel", (F.col("epoch") * N + F.col("sample")).cast("long").alias("sample"), "value")


def resampled(spark, d) -> DataFrame:
    """From 24 to 20 samples a day."""
    return out(S.filtered(numbered(spark, d), float(N), None, None, 20.0, ["subject", "channel"]), ["subject", "channel", "sample"], "value", digits=5)


def line_removed(spark, d) -> DataFrame:
    """Less the six-hour line, where windows of four days find it."""
    return out(S.remove_harmonic(numbered(spark, d), float(N), 6.0, 4.0, 0.5, keys=["subject", "channel"]), ["subject", "channel", "sample"], "value", digits=5)


#: Days of an epoch, the segments it is split into, and the subjects whose segments these are.
DAYS, PARTS, PAIR = 20, 5, 2


def segments(spark, d) -> DataFrame:
    """Epochs of 480 samples, each split into five segments of 96, in which all time constants fit."""
    r = recordings(spark, d, PAIR).withColumns({"sample": F.pmod("epoch", F.lit(DAYS)) * N + F.col("sample"), "epoch": F.floor(F.col("epoch") / DAYS).cast("int")})
    return S.split_epochs(r, DAYS * N, PARTS)


def segment_wsmi(spark, d) -> DataFrame:
    """Each pair's symbolic information at all five time constants, with the frequency (in cycles a day) that each stands for."""
    names = P.channel_names(table(spark, d, "events").select(F.col("event_type").alias("channel")))
    w = Y.block_information(Y.information_blocks(segments(spark, d), names, DAYS * N // PARTS, TAUS), names)
    hz = spark.createDataFrame(list(zip(TAUS, time_constant_hz(TAUS, float(N)), strict=True)), "tau int, hz double")
    return out(w.join(F.broadcast(hz), "tau"), ["subject", "tau", "ch_i", "ch_j"], "hz", "w")


QUERIES = {
    "segment_wsmi": segment_wsmi,
    "resampled_signal": resampled,
    "harmonic_line_removed": line_removed,
    "multitaper_wpli": lambda s, d: out(wpli(s, d), ["subject", "ch_i", "ch_j"], "freq", "w"),
    "multitaper_band_wpli": band_wpli,
    "multitaper_channel_wpli": channel_wpli,
    "multitaper_subject_power": power,
}


def tapers_sql(n: int, bandwidth: float) -> str:
    """The tapers as rows (k, sample, taper)."""
    own = S.tapers(n, bandwidth)
    return "(VALUES " + ",".join(f"({k},{t},CAST({float(x)!r} AS DOUBLE))" for k, row in enumerate(own) for t, x in enumerate(row)) + ") t(k,sample,taper)"


_R = f"""r AS (SELECT CAST(user_id%{SUBJECTS} AS INT) AS subject, event_type AS channel, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, CAST(hour(ts) AS INT) AS sample, avg(value) AS value
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""
#: Frequencies are those of 32 samples, the next power of two.
_T = f"""{_R}, tp AS (SELECT * FROM {tapers_sql(N, SMOOTHING)}), b AS (SELECT freq FROM (SELECT unnest(range(0,17))*{N}/32.0::DOUBLE AS freq) WHERE freq BETWEEN {LO} AND {HI}),
x AS (SELECT subject, channel, epoch, k, freq, sum(value*taper*cos(-2*pi()*freq*sample/{N})) AS re, sum(value*taper*sin(-2*pi()*freq*sample/{N})) AS im FROM r JOIN tp USING (sample), b GROUP BY ALL)"""
_W = f"""{_T}, c AS (SELECT a.subject, a.epoch, a.freq, a.channel AS ch_i, b.channel AS ch_j, avg(a.im*b.re-a.re*b.im) AS im FROM x a JOIN x b ON a.subject=b.subject AND a.epoch=b.epoch AND a.freq=b.freq AND a.k=b.k AND a.channel<b.channel GROUP BY ALL),
w AS (SELECT subject, freq, ch_i, ch_j, (sum(im)**2-sum(im**2))/nullif(sum(abs(im))**2-sum(im**2),0) AS w FROM c GROUP BY ALL)"""
_SEG = f"""g0 AS (SELECT CAST(user_id%{PAIR} AS INT) AS subject, event_type AS channel, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, hour(ts) AS h, avg(value) AS value
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
g AS (SELECT subject, channel, day//{DAYS}*{PARTS}+(day%{DAYS}*{N}+h)//{DAYS * N // PARTS} AS epoch, (day%{DAYS}*{N}+h)%{DAYS * N // PARTS} AS sample, value FROM g0),
tau AS (SELECT CAST(unnest({list(TAUS)}) AS INT) AS tau),
z AS (SELECT tau, a.subject, a.channel, a.epoch, a.sample, CASE WHEN a.value<=b.value AND b.value<=c.value THEN 0 WHEN a.value<=c.value AND c.value<b.value THEN 1 WHEN b.value<a.value AND a.value<=c.value THEN 2
  WHEN c.value<a.value AND a.value<=b.value THEN 3 WHEN b.value<=c.value AND c.value<a.value THEN 4 ELSE 5 END AS x FROM tau, g a
  JOIN g b ON b.subject=a.subject AND b.channel=a.channel AND b.epoch=a.epoch AND b.sample=a.sample+tau JOIN g c ON c.subject=a.subject AND c.channel=a.channel AND c.epoch=a.epoch AND c.sample=a.sample+2*tau),
j AS (SELECT a.tau, a.subject, a.epoch, a.channel AS ch_i, b.channel AS ch_j, a.x, b.x AS y, CAST(count(*) AS DOUBLE) AS n FROM z a JOIN z b ON a.tau=b.tau AND a.subject=b.subject AND a.epoch=b.epoch AND a.sample=b.sample AND a.channel<b.channel GROUP BY ALL),
t AS (SELECT tau, subject, epoch, ch_i, ch_j, CASE WHEN x=y OR y=5-x THEN 0 ELSE 1 END*n/sum(n) OVER p*ln(n*sum(n) OVER p/(sum(n) OVER (PARTITION BY tau,subject,epoch,ch_i,ch_j,x)*sum(n) OVER (PARTITION BY tau,subject,epoch,ch_i,ch_j,y))) AS term
  FROM j WINDOW p AS (PARTITION BY tau, subject, epoch, ch_i, ch_j)),
e AS (SELECT tau, subject, epoch, ch_i, ch_j, sum(term)/ln(6) AS w FROM t GROUP BY ALL)"""
_BANDS = "(VALUES " + ",".join(map(str, BANDS)) + ") t(band,lo,hi)"
ORACLE = {
    "segment_wsmi": f"WITH {_SEG} SELECT subject, tau, ch_i, ch_j, round({N}.0::DOUBLE/3/tau,9) AS hz, round(greatest(avg(w),0.0),9) AS w FROM e GROUP BY ALL",
    "multitaper_wpli": f"WITH {_W} SELECT subject, ch_i, ch_j, freq, round(w,9) AS w FROM w",
    "multitaper_band_wpli": f"""WITH {_W}, p AS (SELECT subject, band, freq FROM (SELECT subject, band, freq, row_number() OVER (PARTITION BY subject, band ORDER BY round(avg(w),9) DESC, freq) AS n
  FROM w JOIN {_BANDS} ON freq BETWEEN lo AND hi GROUP BY subject, band, freq) WHERE n=1) SELECT subject, band, ch_i, ch_j, freq, round(w,9) AS w FROM w JOIN p USING (subject, freq)""",
    "multitaper_channel_wpli": f"""WITH {_W} SELECT subject, channel, freq, round(avg(w),9) AS w FROM (SELECT subject, freq, ch_i AS channel, w FROM w UNION ALL SELECT subject, freq, ch_j, w FROM w) GROUP BY ALL""",
    "multitaper_subject_power": f"""WITH {_T} SELECT subject, channel, freq, round(avg(p)+1e-8,5) AS power FROM (SELECT subject, channel, epoch, freq, avg(re*re+im*im)*2/{N} AS p FROM x GROUP BY ALL) GROUP BY ALL""",
}
