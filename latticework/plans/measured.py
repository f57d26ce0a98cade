"""Measure queries: nodal metrics reduced to scores, best densities, power features, rejection reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators import graph as G
from latticework.operators import measures as M
from latticework.operators import stats as T
from latticework.operators.ranks import pair_ranks
from latticework.operators.reference import thresholds
from latticework.operators.similarity import subject_pairs_nmi
from latticework.plans import cohort, graphs, signals
from latticework.session import table


def degrees(spark, d):
    """Degree of each node at all 37 densities, as nodal metrics."""
    t = thresholds(spark)
    e = G.sweep(G.ranked(graphs.conn(spark, d), graphs.KEYS), t)
    channels = graphs.nodes(spark, d).withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(36))))
    return G.degree(e, ["label", "t_idx"], channels).select("label", "t_idx", F.col("node").alias("channel"), F.lit("degree").alias("metric"), F.col("degree").cast("double").alias("value"))


def scores(spark, d):
    s = M.scores(degrees(spark, d), [M.measure("Degree"), M.Measure("degree", "max"), M.Measure("degree", "mean")], ["label", "t_idx"])
    return s.select("label", "t_idx", "feature", r9(F.col("score")).alias("score"))


def best(spark, d):
    """Eight positions as a feature's densities: each pair's statistics at its best one."""
    s = cohort.scores(spark, d).withColumn("t_idx", (F.col("feature") % 8).cast("int")).withColumn("feature", F.floor(F.col("feature") / 8).cast("int"))
    keys = ["feature", "t_idx"]
    st = T.rank_statistics(pair_ranks(s, keys), keys)
    b = M.best_density(st.select("feature", "g0", "g1", "t_idx", "auc", "u_min"), ["feature", "g0", "g1"])
    return b.select("feature", "g0", "g1", "t_idx", r9(F.col("auc")).alias("auc"), "u_min")


def power(spark, d):
    p = M.power_features(signals.spectrum(spark, d), signals.bands(spark))
    return p.select("band", *[r9(F.col(c)).alias(c) for c in ("power_mean", "power_sd", "rel_mean", "rel_sd")])


def report(spark, d):
    s = signals.samples(spark, d).groupBy("channel", "epoch").agg(F.count("*").alias("n"))
    return M.rejection_report(s.withColumn("rejected", F.col("n") < 24), ["channel"]).select("channel", "n_rejected", "n_kept", r9(F.col("minutes")).alias("minutes"))


def density_nmi(spark, d):
    """NMI of every pair of labels' partitions (degree modulo 3), averaged over the densities from 0.5 to 0.1, in the order of the labels' parity."""
    m = degrees(spark, d).filter("t_idx >= 20").select("label", "t_idx", F.col("channel").alias("node"), (F.col("value") % 3).cast("int").alias("module"))
    each = subject_pairs_nmi(m, ["t_idx"], "label")
    mean = each.groupBy("s1", "s2").agg(r9(F.avg("nmi")).alias("nmi"))
    place = lambda c: (F.col(c) % 2 * 100 + F.col(c)).cast("int")
    return mean.select("s1", "s2", place("s1").alias("row"), place("s2").alias("col"), "nmi")


def covariates(spark, d):
    """Subjects with a group: nations, whose keys are the graphs' labels too, and their regions."""
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("subject"), F.col("n_regionkey").cast("int").alias("grp"))


def cohort_measures(spark, d):
    """Mean and standard error over each group's subjects of the features at all densities; subjects without a covariate take no part."""
    s = scores(spark, d).withColumnRenamed("label", "subject").join(covariates(spark, d), "subject").filter("grp is not null")
    m = T.mean_sem(s, "score", ["grp", "t_idx", "feature"])
    return m.select("grp", "t_idx", "feature", r9(F.col("mean")).alias("mean"), r9(F.col("sem")).alias("sem"))


def control_nmi(spark, d):
    """Each subject's mean similarity with the control subjects, those of the last group, itself left out."""
    n = density_nmi(spark, d)
    both = n.select(F.explode(F.array(F.struct(F.col("s1").alias("subject"), F.col("s2").alias("other")), F.struct(F.col("s2").alias("subject"), F.col("s1").alias("other")))).alias("p"), "nmi").select("p.*", "nmi")
    c = covariates(spark, d).join(table(spark, d, "embeddings").select(F.col("label").cast("long").alias("subject")).distinct(), "subject", "left_semi")
    last = c.agg(F.max("grp").alias("grp"))
    controls = c.join(F.broadcast(last), "grp").select(F.col("subject").alias("other"))
    return both.join(controls, "other", "left_semi").groupBy("subject").agg(r9(F.avg("nmi")).alias("nmi"))


def patient(spark, d):
    """The subject with the largest label against the groups of the others: it is a group of its own, one above the last; its error is null."""
    s = scores(spark, d).withColumnRenamed("label", "subject").join(covariates(spark, d), "subject")
    top = s.agg(F.max("subject").alias("patient"), F.max("grp").alias("last"))
    s = s.join(F.broadcast(top))
    cohort = s.filter("subject < patient").select("grp", "t_idx", "feature", "score")
    own = s.filter("subject = patient").select((F.col("last") + 1).alias("grp"), "t_idx", "feature", "score")
    m = T.mean_sem(cohort.unionByName(own), "score", ["grp", "t_idx", "feature"])
    return m.select("grp", "t_idx", "feature", r9(F.col("mean")).alias("mean"), r9(F.col("sem")).alias("sem"))


def mean_of_means(spark, d):
    """Mean over densities of the mean degree of channels."""
    per = degrees(spark, d).groupBy("label", "t_idx").agg(F.avg("value").alias("m"))
    return per.groupBy("label").agg(r9(F.avg("m")).alias("mean"))


QUERIES = {"cohort_measures": cohort_measures, "control_nmi": control_nmi, "patient_against_cohort": patient, "mean_of_means": mean_of_means, "density_nmi": density_nmi, "measure_scores": scores, "best_density": best, "power_features": power, "rejection_report": report}

_DEG = f"WITH {graphs._RK}, t AS (SELECT CAST(k AS INT) AS t_idx, (1000-25*k)/1000.0 AS p FROM (SELECT unnest(range(0,37)) AS k)), e AS (SELECT label, t_idx, i, j FROM rk JOIN t ON r<=round(n*CAST(p AS DOUBLE)) AND w<>0), en AS (SELECT label, t_idx, i AS node FROM e UNION ALL SELECT label, t_idx, j FROM e), deg AS (SELECT n.label, t.t_idx, n.node, CAST(count(en.node) AS DOUBLE) AS v FROM (SELECT DISTINCT label, ch AS node FROM v) n CROSS JOIN t LEFT JOIN en ON en.label=n.label AND en.t_idx=t.t_idx AND en.node=n.node GROUP BY ALL)"

_NMI = f"{_DEG}, m AS (SELECT label, t_idx, node, CAST(v%3 AS INT) AS m FROM deg WHERE t_idx>=20), j AS (SELECT a.label AS s1, b.label AS s2, a.t_idx, a.m AS m1, b.m AS m2, CAST(count(*) AS DOUBLE) AS n FROM m a JOIN m b ON a.t_idx=b.t_idx AND a.node=b.node AND a.label<b.label GROUP BY ALL), p AS (SELECT s1, s2, t_idx, n/sum(n) OVER g AS p, sum(n) OVER (PARTITION BY s1,s2,t_idx,m1)/sum(n) OVER g AS px, sum(n) OVER (PARTITION BY s1,s2,t_idx,m2)/sum(n) OVER g AS py FROM j WINDOW g AS (PARTITION BY s1, s2, t_idx)), k AS (SELECT s1, s2, t_idx, CASE WHEN sum(-p*ln(px))+sum(-p*ln(py))=0 THEN 1.0 ELSE 2*sum(p*ln(p/(px*py)))/(sum(-p*ln(px))+sum(-p*ln(py))) END AS nmi FROM p GROUP BY ALL)"
_SCORES = f"{_DEG}, a AS (SELECT label, t_idx, avg(v) AS m, stddev_samp(v) AS s, max(v) AS x FROM deg GROUP BY ALL) SELECT label, t_idx, 'degree/mean' AS feature, round(m,9) AS score FROM a UNION ALL SELECT label, t_idx, 'degree/sd', round(s,9) FROM a UNION ALL SELECT label, t_idx, 'degree/max', x FROM a"
_COV = f"WITH sc0 AS ({_SCORES}), sc AS (SELECT label AS subject, t_idx, feature, score, CAST(n_regionkey AS INT) AS grp FROM sc0 JOIN nation ON n_nationkey=label)"

ORACLE = {
    "cohort_measures": f"{_COV} SELECT grp, t_idx, feature, round(avg(score),9) AS mean, round(stddev_samp(score)/sqrt(count(*)),9) AS sem FROM sc GROUP BY ALL",
    "control_nmi": f"{_NMI}, mm AS (SELECT s1, s2, round(avg(nmi),9) AS nmi FROM k GROUP BY s1, s2), c AS (SELECT n_nationkey AS s, n_regionkey AS g FROM nation WHERE n_nationkey IN (SELECT label FROM embeddings)), o AS (SELECT s FROM c WHERE g=(SELECT max(g) FROM c)), bb AS (SELECT s1 AS subject, s2 AS other, nmi FROM mm UNION ALL SELECT s2, s1, nmi FROM mm) SELECT CAST(subject AS BIGINT) AS subject, round(avg(nmi),9) AS nmi FROM bb WHERE other IN (SELECT s FROM o) GROUP BY 1",
    "patient_against_cohort": f"{_COV}, pg AS (SELECT CASE WHEN subject=(SELECT max(subject) FROM sc) THEN (SELECT max(grp) FROM sc)+1 ELSE grp END AS grp, t_idx, feature, score FROM sc) SELECT CAST(grp AS INT) AS grp, t_idx, feature, round(avg(score),9) AS mean, round(stddev_samp(score)/sqrt(count(*)),9) AS sem FROM pg GROUP BY ALL",
    "mean_of_means": f"{_DEG}, m AS (SELECT label, t_idx, avg(v) AS m FROM deg GROUP BY ALL) SELECT label, round(avg(m),9) AS mean FROM m GROUP BY 1",
    "density_nmi": f"{_DEG}, m AS (SELECT label, t_idx, node, CAST(v%3 AS INT) AS m FROM deg WHERE t_idx>=20), j AS (SELECT a.label AS s1, b.label AS s2, a.t_idx, a.m AS m1, b.m AS m2, CAST(count(*) AS DOUBLE) AS n FROM m a JOIN m b ON a.t_idx=b.t_idx AND a.node=b.node AND a.label<b.label GROUP BY ALL), p AS (SELECT s1, s2, t_idx, n/sum(n) OVER g AS p, sum(n) OVER (PARTITION BY s1,s2,t_idx,m1)/sum(n) OVER g AS px, sum(n) OVER (PARTITION BY s1,s2,t_idx,m2)/sum(n) OVER g AS py FROM j WINDOW g AS (PARTITION BY s1, s2, t_idx)), k AS (SELECT s1, s2, t_idx, CASE WHEN sum(-p*ln(px))+sum(-p*ln(py))=0 THEN 1.0 ELSE 2*sum(p*ln(p/(px*py)))/(sum(-p*ln(px))+sum(-p*ln(py))) END AS nmi FROM p GROUP BY ALL) SELECT s1, s2, CAST(s1%2*100+s1 AS INT) AS row, CAST(s2%2*100+s2 AS INT) AS col, round(avg(nmi),9) AS nmi FROM k GROUP BY s1, s2",
    "measure_scores": f"{_DEG}, a AS (SELECT label, t_idx, avg(v) AS m, stddev_samp(v) AS s, max(v) AS x FROM deg GROUP BY ALL) SELECT label, t_idx, 'degree/mean' AS feature, round(m,9) AS score FROM a UNION ALL SELECT label, t_idx, 'degree/sd', round(s,9) FROM a UNION ALL SELECT label, t_idx, 'degree/max', x FROM a",
    "best_density": f"{cohort._EM}{cohort._ST}, b AS (SELECT CAST(floor(feature/8) AS INT) AS f, g0, g1, CAST(feature%8 AS INT) AS t_idx, round(auc,9) AS auc, u_min, row_number() OVER (PARTITION BY floor(feature/8), g0, g1 ORDER BY round(auc,9) DESC, feature%8) AS r FROM st) SELECT f AS feature, g0, g1, t_idx, auc, u_min FROM b WHERE r=1",
    "power_features": f"WITH {signals._P}, m AS (SELECT band, channel, avg(power) AS power FROM p JOIN bands ON bin BETWEEN lo AND hi GROUP BY ALL), sh AS (SELECT *, power/sum(power) OVER (PARTITION BY channel) AS rel FROM m) SELECT band, round(avg(power),9) AS power_mean, round(stddev_samp(power),9) AS power_sd, round(avg(rel),9) AS rel_mean, round(stddev_samp(rel),9) AS rel_sd FROM sh GROUP BY band",
    "rejection_report": f"WITH {signals._S}, k AS (SELECT channel, epoch, count(*)<24 AS bad FROM s GROUP BY ALL) SELECT channel, count(*) FILTER (bad) AS n_rejected, count(*) FILTER (NOT bad) AS n_kept, round(count(*) FILTER (NOT bad)*10/60.0,9) AS minutes FROM k GROUP BY 1",
}
