"""Queries over what a screening keeps, tables behind plots, and all named measures of one set of graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators import geometry as M
from latticework.operators import graph as G
from latticework.operators import measures as R
from latticework.operators import screening as Q
from latticework.operators.boxes import box_table
from latticework.operators.selection import matrix_median
from latticework.operators.similarity import subject_pairs_nmi
from latticework.operators.sweep import median_rows
from latticework.plans import cohort, covariates, graphs, measured, subjects
from latticework.session import kept, table

#: The largest mean variance of a channel and of an epoch of events, whose values deviate by about 49.
LOUD, EPOCH = 2300.0, 3000.0


def judged(spark, d) -> tuple[DataFrame, DataFrame]:
    v = kept(Q.variances(subjects.recordings(spark, d)), "variances")
    channels = kept(Q.judged_channels(v, LOUD), "channels")
    return channels, Q.judged_epochs(v, channels, EPOCH)


def report(spark, d) -> DataFrame:
    channels, epochs = judged(spark, d)
    return Q.screening_report(channels, kept(epochs, "epochs"), wanted=20).withColumn("minutes", r9(F.col("minutes")))


def screened(spark, d) -> DataFrame:
    """Subjects' samples of the channels and epochs that stay."""
    return Q.screened(subjects.recordings(spark, d), *judged(spark, d)).select("subject", "channel", "epoch", "sample", r9(F.col("value")).alias("value"))


def without_rim(spark, d) -> DataFrame:
    """Pairs of labels as recordings of 128 channels, less the rim of such a net: means of the channels that stay."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    channel = F.concat(F.lit("E"), (F.pmod("label", F.lit(2)) * 64 + F.col("at") + 1).cast("int").cast("string"))
    mean = e.groupBy(F.floor(F.col("label") / 2).cast("int").alias("recording"), channel.alias("channel")).agg(F.avg(F.col("v").cast("double")).alias("mean"))
    return Q.within_net(mean, ["recording"]).select("recording", "channel", r9(F.col("mean")).alias("mean"))


def boxes(spark, d) -> DataFrame:
    b = box_table(cohort.scores(spark, d).select("feature", "grp", "score"), "score", ["feature", "grp"])
    return b.select("feature", "grp", "n", "n_outliers", *[r9(F.col(c)).alias(c) for c in ("mean", "sd", "lo95", "hi95", "q1", "median", "q3", "low", "high")])


def pooled(spark, d) -> DataFrame:
    """Medians of the labels' whole matrices, even and odd labels apart."""
    c = graphs.conn(spark, d).withColumn("grp", F.pmod("label", F.lit(2)).cast("int"))
    return matrix_median(c, ["grp", "label"], ["grp"]).select("grp", r9(F.col("median")).alias("median"))


#: How far points are moved, by how much they are turned, and scaled.
SHIFT, TURN, SCALE = (0.5, -6.0, 46.0), (0.1, -math.pi / 16, -1.57), (100.0, 94.0, 90.0)


def transformed(spark, d) -> DataFrame:
    p = M.rotated(covariates.points(spark, d), "+y")
    return M.transformed(p, M.placement(SHIFT, TURN, SCALE)).select("channel", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in "xyz"])


def metrics(spark, d) -> DataFrame:
    """label, channel, metric, value of every named measure: power of a position as its share over labels; betweenness, participation, degree and modules (node mod 4) of the strongest 10 %; median connectivity; and the similarity of a label's degrees (modulo 3) with the other labels'."""
    conn, nodes = kept(graphs.conn(spark, d), "connectivity"), kept(graphs.nodes(spark, d), "nodes")
    edges = G.cut(G.ranked(conn, graphs.KEYS), 0.1).select("label", "i", "j", "w")
    own = lambda df, name, value: df.select("label", F.col("node").alias("channel"), F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"))
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("node", "v"))
    square = e.groupBy("label", F.col("node").cast("long").alias("node")).agg(F.avg(F.col("v").cast("double") ** 2).alias("power"))
    square = square.withColumn("power", F.col("power") / F.nullif(F.sum("power").over(Window.partitionBy("node")), F.lit(0.0)))
    degree = kept(G.degree(edges, graphs.KEYS, nodes), "degrees")
    n = subject_pairs_nmi(degree.select("label", "node", (F.col("degree") % 3).alias("module")), subject="label")
    side = lambda a, b: n.select(F.col(a).alias("label"), F.col(b).alias("node"), "nmi")
    parts = [
        own(square, "power", "power"),
        own(G.betweenness(edges, graphs.KEYS, nodes), "centrality", "betweenness"),
        own(G.participation(edges, graphs.modules(nodes), graphs.KEYS), "participation coefficient", "participation"),
        own(degree, "degree", "degree"),
        own(graphs.modules(nodes), "modules", "module"),
        own(side("s1", "s2").unionByName(side("s2", "s1")), "mutual information", "nmi"),
        median_rows(conn, graphs.KEYS).select("label", "channel", "metric", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preset_scores(spark, d) -> DataFrame:
    """Each label's score of every measure, reduced over channels as the measure's name says."""
    s = R.scores(metrics(spark, d), [*R.PRESETS.values(), R.measure("median")], ["label"])
    return s.select("label", "feature", r9(F.col("score")).alias("score"))


def grouped_nmi(spark, d) -> DataFrame:
    """Similarities of the labels, placed in a matrix in the order of their groups (the nations' regions), then of the labels."""
    c = measured.covariates(spark, d).filter("grp is not null")
    place = c.withColumn("place", F.row_number().over(Window.orderBy("grp", "subject")))  # a row for each subject
    n = measured.density_nmi(spark, d).select("s1", "s2", "nmi")
    for s, name in (("s1", "row"), ("s2", "col")):
        n = n.join(place.select(F.col("subject").alias(s), F.col("grp").alias(f"g_{name}"), F.col("place").alias(name)), s)
    return n.select("s1", "s2", "g_row", "g_col", "row", "col", "nmi")


QUERIES = {
    "screening_report": report,
    "screened_recordings": screened,
    "channels_within_net": without_rim,
    "box_plot": boxes,
    "pooled_matrix_median": pooled,
    "transformed_channels": transformed,
    "preset_scores": preset_scores,
    "grouped_nmi": grouped_nmi,
}

_J = f"""{subjects._R}, va AS (SELECT subject, channel, epoch, var_samp(value) AS v FROM r GROUP BY ALL),
ch AS (SELECT subject, channel, coalesce(avg(v)>{LOUD} OR avg(v)<=0, true) AS bad FROM va GROUP BY ALL),
ep AS (SELECT va.subject, va.epoch, coalesce(avg(CASE WHEN NOT bad THEN v END)>{EPOCH}, true) AS bad FROM va JOIN ch USING (subject, channel) GROUP BY ALL)"""
_BOX = f"""{cohort._EM}, o AS (SELECT feature, grp, score, row_number() OVER (PARTITION BY feature, grp ORDER BY score) AS k, count(*) OVER (PARTITION BY feature, grp) AS n FROM sc WHERE score IS NOT NULL),
h AS (SELECT feature, grp, any_value(n) AS n, unnest([0.25::DOUBLE,0.5::DOUBLE,0.75::DOUBLE]) AS p FROM o GROUP BY feature, grp),
pl AS (SELECT *, greatest(1.0::DOUBLE, least(CAST(n AS DOUBLE), n*p+0.5)) AS pos FROM h),
qs AS (SELECT pl.feature, pl.grp, p, a.score+(pos-floor(pos))*(b.score-a.score) AS q FROM pl JOIN o a ON a.feature=pl.feature AND a.grp=pl.grp AND a.k=CAST(floor(pos) AS BIGINT) JOIN o b ON b.feature=pl.feature AND b.grp=pl.grp AND b.k=least(CAST(floor(pos) AS BIGINT)+1, pl.n)),
bx AS (SELECT feature, grp, max(q) FILTER (p=0.25) AS q1, max(q) FILTER (p=0.5) AS median, max(q) FILTER (p=0.75) AS q3 FROM qs GROUP BY ALL),
w AS (SELECT o.feature, o.grp, score, q1, median, q3, score BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) AS inside FROM o JOIN bx ON o.feature=bx.feature AND o.grp=bx.grp)"""
_cos, _sin = [math.cos(t) for t in TURN], [math.sin(t) for t in TURN]
#: +y noses are turned by three quarters, points scaled, turned about z, y and x, and moved.
_TURNED = f"""WITH c AS (SELECT vec_id AS channel, CAST(embedding[2] AS DOUBLE)*{SCALE[0]} AS x, -CAST(embedding[1] AS DOUBLE)*{SCALE[1]} AS y, CAST(embedding[3] AS DOUBLE)*{SCALE[2]} AS z FROM embeddings),
tz AS (SELECT channel, {_cos[2]!r}::DOUBLE*x-({_sin[2]!r}::DOUBLE)*y AS x, {_sin[2]!r}::DOUBLE*x+{_cos[2]!r}::DOUBLE*y AS y, z FROM c),
ty AS (SELECT channel, {_cos[1]!r}::DOUBLE*x+({_sin[1]!r}::DOUBLE)*z AS x, y, {_cos[1]!r}::DOUBLE*z-({_sin[1]!r}::DOUBLE)*x AS z FROM tz),
tx AS (SELECT channel, x, {_cos[0]!r}::DOUBLE*y-({_sin[0]!r}::DOUBLE)*z AS y, {_sin[0]!r}::DOUBLE*y+{_cos[0]!r}::DOUBLE*z AS z FROM ty)
SELECT channel, round(x+{SHIFT[0]}+1e-8,6) AS x, round(y+({SHIFT[1]})+1e-8,6) AS y, round(z+{SHIFT[2]}+1e-8,6) AS z FROM tx"""
_MEASURES = f"""WITH pw0 AS (SELECT label, node, avg(x*x) AS v FROM (SELECT label, CAST(unnest(range(0,len(embedding))) AS BIGINT) AS node, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
pw AS (SELECT label, 'power/mean' AS feature, 100*avg(v/t) AS score FROM (SELECT *, sum(v) OVER (PARTITION BY node) AS t FROM pw0) GROUP BY label),
bt AS (SELECT label, 'centrality/sd' AS feature, stddev_samp(betweenness) AS score FROM ({graphs.ORACLE["betweenness"]}) GROUP BY label),
gs AS (SELECT * FROM (WITH {graphs._SPARSE} SELECT * FROM deg)),
ad AS (SELECT * FROM (WITH {graphs._SPARSE} SELECT label, a, b FROM adj)),
dg AS (SELECT label, 'degree/sd' AS feature, stddev_samp(degree) AS score FROM gs GROUP BY label),
mo AS (SELECT label, 'modules/max' AS feature, CAST(max(node%4+1) AS DOUBLE) AS score FROM gs GROUP BY label),
kk AS (SELECT label, a AS node, b%4 AS m, CAST(count(*) AS DOUBLE) AS k FROM ad GROUP BY ALL),
pa AS (SELECT gs.label, gs.node, coalesce(1-sum(k*k)/(sum(k)*sum(k)),0.0) AS v FROM gs LEFT JOIN kk ON kk.label=gs.label AND kk.node=gs.node GROUP BY ALL),
pc AS (SELECT label, 'participation coefficient/sd' AS feature, stddev_samp(v) AS score FROM pa GROUP BY label),
ni AS (SELECT * FROM ({graphs.ORACLE["subject_partition_nmi"].replace(graphs._E, graphs._SPARSE)})),
mi AS (SELECT label, 'mutual information/mean' AS feature, avg(nmi) AS score FROM (SELECT s1 AS label, nmi FROM ni UNION ALL SELECT s2, nmi FROM ni) GROUP BY label),
cn AS (SELECT * FROM ({graphs.ORACLE["corr_connectivity"]})),
rw AS (SELECT label, node, median(w) AS v FROM (SELECT label, i AS node, w FROM cn UNION ALL SELECT label, j, w FROM cn UNION ALL SELECT DISTINCT label, unnest([i,j]), 0.0::DOUBLE FROM cn) GROUP BY ALL),
md AS (SELECT label, 'median/mean' AS feature, avg(v) AS score FROM rw GROUP BY label)"""

ORACLE = {
    "screening_report": f"""WITH {_J}, a AS (SELECT subject, count(*) AS n_channels, count(*) FILTER (bad) AS n_bad_channels FROM ch GROUP BY 1), f AS (SELECT *, min(epoch) OVER (PARTITION BY subject) AS first FROM ep),
  b AS (SELECT subject, count(*) AS n_epochs, count(*) FILTER (bad) AS n_bad_epochs, (20+count(*) FILTER (bad AND epoch-first<20))*10/60.0::DOUBLE AS minutes FROM f GROUP BY 1) SELECT subject, n_channels, n_bad_channels, n_epochs, n_bad_epochs, round(minutes,9) AS minutes FROM a JOIN b USING (subject)""",
    "screened_recordings": f"WITH {_J} SELECT subject, channel, CAST(epoch AS INT) AS epoch, sample, round(value,9) AS value FROM r JOIN ch USING (subject, channel) JOIN ep USING (subject, epoch) WHERE NOT ch.bad AND NOT ep.bad",
    "channels_within_net": f"""WITH u AS (SELECT label, unnest(range(0,len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(label//2 AS INT) AS recording, 'E'||(label%2*64+pos+1) AS channel, round(avg(v),9) AS mean FROM u
  WHERE 'E'||(label%2*64+pos+1) NOT IN ({",".join(f"'{c}'" for c in Q.RIM_128)}) GROUP BY ALL""",
    "box_plot": f"""WITH {_BOX.removeprefix("WITH ")} SELECT feature, grp, count(*) AS n, count(*) FILTER (NOT inside) AS n_outliers, round(avg(score),9) AS mean, round(stddev_samp(score),9) AS sd,
  round(avg(score)-1.96*stddev_samp(score)/sqrt(count(*)),9) AS lo95, round(avg(score)+1.96*stddev_samp(score)/sqrt(count(*)),9) AS hi95, round(any_value(q1),9) AS q1, round(any_value(median),9) AS median, round(any_value(q3),9) AS q3,
  round(min(score) FILTER (inside),9) AS low, round(max(score) FILTER (inside),9) AS high FROM w GROUP BY feature, grp""",
    "pooled_matrix_median": f"WITH cn AS (SELECT * FROM ({graphs.ORACLE['corr_connectivity']})) SELECT CAST(label%2 AS INT) AS grp, round(median(w),9) AS median FROM (SELECT label, w FROM cn UNION ALL SELECT label, w FROM cn UNION ALL SELECT label, 0.0::DOUBLE FROM (SELECT DISTINCT label, unnest([i,j]) FROM cn)) GROUP BY 1",
    "transformed_channels": _TURNED,
    "preset_scores": f"{_MEASURES} SELECT label, feature, round(score,9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("pw", "bt", "dg", "mo", "pc", "mi", "md")) + ")",
    "grouped_nmi": f"WITH n AS (SELECT * FROM ({measured.ORACLE['density_nmi']})), p AS (SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_regionkey AS INT) AS g, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INT) AS k FROM nation WHERE n_regionkey IS NOT NULL) SELECT s1, s2, a.g AS g_row, b.g AS g_col, a.k AS row, b.k AS col, nmi FROM n JOIN p a ON a.s=s1 JOIN p b ON b.s=s2",
}
