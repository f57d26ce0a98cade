"""Queries over places and models: head geometry, source density, components, classifiers, choices of densities and pairs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import percent_of, r9
from latticework.operators import classify as C
from latticework.operators import geometry as M
from latticework.operators import signal as S
from latticework.operators import stats as T
from latticework.operators.components import independent_components
from latticework.operators.reference import nearest_density, thresholds
from latticework.plans import cohort, covariates, measured, signals
from latticework.session import table

#: Rows a classifier learns from, at most.
MOST = 20_000


def sphere(names: list, column: str) -> pd.DataFrame:
    """Places spread evenly over the unit sphere, one for each name."""
    z = [1 - (2 * k + 1) / len(names) for k in range(len(names))]
    turn = [math.pi * (3 - math.sqrt(5)) * k for k in range(len(names))]
    return pd.DataFrame({column: names, "x": [math.sqrt(1 - h * h) * math.cos(t) for h, t in zip(z, turn, strict=True)], "y": [math.sqrt(1 - h * h) * math.sin(t) for h, t in zip(z, turn, strict=True)], "z": z})


def placed(spark, d) -> pd.DataFrame:
    """The event types, a montage's channels, on the sphere."""
    return sphere(sorted(r[0] for r in table(spark, d, "events").filter("event_type is not null").select("event_type").distinct().collect()), "channel")


def rotated(spark, d):
    return M.rotated(covariates.points(spark, d), "+y").select("channel", *[r9(F.col(c)).alias(c) for c in "xyz"])


def scalp(spark, d):
    """Even positions of each label's montage on the mesh of its odd ones."""
    own = covariates.montages(spark, d)
    mesh = own.filter("channel % 2 = 1").withColumnRenamed("channel", "vertex")
    got = M.on_scalp(own.filter("channel % 2 = 0"), mesh, keys=["label"])
    return got.select("label", "channel", *[r9(F.col(c)).alias(c) for c in "xyz"])


def source_density(spark, d):
    """Of each month's mean day."""
    s = signals.samples(spark, d).groupBy(F.floor(F.col("epoch") / 30).cast("int").alias("month"), "channel", "sample").agg(F.avg("value").alias("value"))
    return signals.out(S.surface_laplacian(s, placed(spark, d), ["month"]), ["month", "channel", "sample"], "value")


def less_component(spark, d):
    """Weeks as recordings, without their least normal component."""
    s = signals.samples(spark, d)
    weeks = s.select(F.floor(F.col("epoch") / 7).cast("int").alias("week"), "channel", (F.col("epoch") * 24 + F.col("sample")).cast("int").alias("sample"), "value")
    return signals.out(independent_components(weeks, ["week"], reject=[0]), ["week", "channel", "sample"], "value")


def head_map(spark, d):
    """Each day's channel means at 64 points of the sphere."""
    means = signals.samples(spark, d).groupBy("epoch", "channel").agg(F.avg("value").alias("value"))
    return signals.out(M.spherical_spline(means, placed(spark, d), sphere(list(range(64)), "vertex"), ["epoch"]), ["epoch", "vertex"], "value")


def folds(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every fifth vector to learn from, at most about MOST, and the others."""
    e = table(spark, d, "embeddings").filter("label is not null and embedding is not null").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    known = e.filter("vec_id % 5 = 0")
    n = known.count()
    return (known if n <= MOST else known.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2 * n)) < 2 * MOST * 9 // 10)), e.filter("vec_id % 5 <> 0")


def neighbour_votes(spark, d):
    known, rest = folds(spark, d)
    return C.nearest_neighbours(known, rest, most=MOST).select("vec_id", "prediction")


def trained(spark, d):
    """Held-out predictions of the label's parity by each kind of classifier."""
    known, rest = folds(spark, d)
    known = known.withColumn("label", F.col("label") % 2)
    out = None
    for kind, components in (("tree", 8), ("svm-linear", None), ("nbayes", None), ("nn", None)):
        own = C.train(known, kind, components).transform(rest).select("vec_id", F.lit(kind).alias("algorithm"), F.col("label") % 2, "prediction").toDF("vec_id", "algorithm", "label", "prediction")
        out = own if out is None else out.unionByName(own)
    return out


def degree_at(spark, d):
    """Degrees at the density nearest to 0.31."""
    return measured.degrees(spark, d).join(F.broadcast(nearest_density(thresholds(spark), 0.31).select("t_idx")), "t_idx").select("label", "channel", "t_idx", F.col("value").alias("degree"))


def pairs(spark, d):
    """Contrasts of listed pairs of groups only."""
    rows = T.rank_statistics(cohort.counts_of(cohort.scores(spark, d)), ["feature"])
    return cohort.out(T.chosen_pairs(rows, [(0, 1), (2, 5)]), cohort.PAIR, "auc")


def rejected_percent(spark, d):
    s = signals.samples(spark, d).groupBy("channel", "epoch").agg(F.count("*").alias("n"))
    return s.groupBy("channel").agg(r9(percent_of(F.count_if(F.col("n") < 24), F.count("*"))).alias("percent"))


QUERIES = {
    "rotated_channels": rotated,
    "scalp_projection": scalp,
    "current_source_density": source_density,
    "components_removed": less_component,
    "head_map": head_map,
    "neighbour_votes": neighbour_votes,
    "trained_classifiers": trained,
    "degree_at_density": degree_at,
    "chosen_pairs": pairs,
    "rejected_percent": rejected_percent,
}

ORACLE = {
    "rotated_channels": f"WITH {covariates._X} SELECT channel, round(y,9) AS x, round(-x,9) AS y, round(z,9) AS z FROM c",
    "scalp_projection": f"WITH {covariates._MO}, n AS (SELECT a.label, a.channel, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.label, a.channel ORDER BY (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2, b.channel) AS r FROM c a JOIN c b ON a.label=b.label WHERE a.channel%2=0 AND b.channel%2=1) SELECT label, channel, round(1.06*avg(x),9) AS x, round(1.06*avg(y),9) AS y, round(1.06*avg(z),9) AS z FROM n WHERE r<=3 GROUP BY ALL",
    "neighbour_votes": "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), n AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS r FROM e q, e t WHERE q.vec_id%5<>0 AND t.vec_id%5=0), c AS (SELECT vec_id, label, count(*) AS k FROM n WHERE r<=5 GROUP BY ALL) SELECT vec_id, CAST(arg_max(label, k*1000-label) AS DOUBLE) AS prediction FROM c GROUP BY vec_id",
    "degree_at_density": f"{measured._DEG} SELECT label, node AS channel, t_idx, v AS degree FROM deg WHERE t_idx=(SELECT t_idx FROM t ORDER BY round(abs(p-0.31),9), t_idx LIMIT 1)",
    "chosen_pairs": f"{cohort._EM}{cohort._ST} SELECT feature, g0, g1, round(auc,9) AS auc FROM st WHERE (g0=0 AND g1=1) OR (g0=2 AND g1=5)",
    "rejected_percent": f"WITH {signals._S}, k AS (SELECT channel, epoch, count(*)<24 AS bad FROM s GROUP BY ALL) SELECT channel, round(100.0*count(*) FILTER (bad)/count(*),9) AS percent FROM k GROUP BY 1",
}
