"""The cohort sweep over `events`: seven measures in three bands for each of 25 subjects, contrasted between the regions of the nations with the subjects' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators import graph as G
from latticework.operators import measures as M
from latticework.operators import signal as S
from latticework.operators import spectra as P
from latticework.operators import sweep as W
from latticework.operators.reference import density_range, thresholds
from latticework.plans import models, subjects
from latticework.plans.measured import covariates
from latticework.plans.signals import bands
from latticework.session import kept, table

COHORT = 25
KEYS = ["subject", "band"]


def nodal(spark, d) -> DataFrame:
    """subject, band, t_idx, channel, metric, value of all measures; those that don't depend on a density have t_idx 0."""
    names = P.channel_names(table(spark, d, "events").select(F.col("event_type").alias("channel")))
    blocks = kept(P.cross_blocks(subjects.recordings(spark, d, COHORT), names, float(subjects.N), subjects.N, subjects.SMOOTHING, subjects.LO, subjects.HI), "blocks")
    power = S.in_bands(P.block_power(blocks, names), bands(spark), "freq").groupBy("subject", "channel", "band").agg(F.avg("power").alias("power"))
    power = S.share(power, "power", ["subject", "channel"]).select(*KEYS, "channel", F.lit("power").alias("metric"), F.col("rel").alias("value"))
    conn = S.band_peak(P.block_wpli(blocks, names), bands(spark), "w", ["ch_i", "ch_j"], ["subject"], freq="freq")
    conn = kept(conn.select(*KEYS, F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), r9(F.col("w")).alias("w")), "connectivity")
    densities = density_range(thresholds(spark))
    ranks = G.ranked(conn, KEYS).select(*KEYS, "i", "j", "w", "rank", "n")
    kept_edges = F.round(F.col("n") * F.col("density").cast("double")).cast("int").alias("m")  # densities that keep as many edges keep the same ones
    sizes = ranks.select(*KEYS, "n").distinct().join(F.broadcast(densities)).select(*KEYS, "t_idx", kept_edges)
    cuts = sizes.select(*KEYS, "m").distinct()
    edges = ranks.join(cuts, KEYS).filter("rank <= m and w <> 0").select(*KEYS, "m", "i", "j", "w")
    graphs = W.graph_measures(edges, [*KEYS, "m"], G.nodes(conn, KEYS).join(cuts, KEYS), models.placed(spark, d)).join(sizes, [*KEYS, "m"])
    graphs = graphs.select(*KEYS, "t_idx", "channel", "metric", "value")
    flat = power.unionByName(W.median_rows(conn, KEYS)).withColumn("t_idx", F.lit(0))
    return graphs.unionByName(flat.select(*KEYS, "t_idx", "channel", "metric", "value"))


def sweep_scores(spark, d) -> DataFrame:
    s = M.scores(nodal(spark, d), W.MEASURES, [*KEYS, "t_idx"])
    return s.select(*KEYS, "t_idx", "feature", r9(F.col("score")).alias("score"))


def feature_sweep(spark, d) -> DataFrame:
    """Each of the 21 features' contrasts at its best density."""
    s = sweep_scores(spark, d).withColumn("subject", F.col("subject").cast("long")).join(covariates(spark, d), "subject").filter("grp is not null")
    return W.contrasts(s, ["band"]).withColumns({"auc": r9(F.col("auc")), "p": r9(F.col("p"))})


QUERIES = {"sweep_scores": sweep_scores, "feature_sweep": feature_sweep}
ORACLE: dict[str, str] = {}
