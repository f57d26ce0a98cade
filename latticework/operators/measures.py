"""Measures as data: which metric, reduced how, over which channels; all features in one grouped query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = {"mean": F.avg, "sd": F.stddev_samp, "max": F.max, "median": F.median}


@dataclass(frozen=True)
class Measure:
    """A metric of graph_nodal or of a power table, the reducer over channels, a factor, and a channel group if any."""

    metric: str
    reducer: str = "mean"
    factor: float = 1.0
    group: str | None = None

    def __post_init__(self):
        if self.reducer not in REDUCERS:
            raise ValueError(f"unknown reducer {self.reducer}")


#: The reductions that go with the measures' names; any other metric is averaged over channels.
PRESETS = {
    "power": Measure("power", "mean", 100.0),
    "modules": Measure("modules", "max"),
    "centrality": Measure("centrality", "sd"),
    "participation coefficient": Measure("participation coefficient", "sd"),
    "degree": Measure("degree", "sd"),
    "mutual information": Measure("mutual information", "mean"),
}
#: The features of the cohort sweep, each in bands 1 to 3.
SWEEP = ("power", "median", "clustering", "characteristic path length", "modularity", "participation coefficient", "modular span")


def measure(name: str) -> Measure:
    """The named measure, whatever its case."""
    return PRESETS.get(name.lower(), Measure(name.lower()))


def scores(nodal: DataFrame, measures: Sequence[Measure], keys: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """keys, feature, score for all measures at once from nodal(keys, channel, metric, value).

    NaN takes no part. Each reducer in use is one aggregate of the same pass; a small table picks each metric's.
    """
    spark = nodal.sparkSession
    rows = [(m.metric, m.reducer, m.factor, m.group or "") for m in measures]
    spec = spark.createDataFrame(rows, "metric string, reducer string, factor double, grp string")
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    hit = nodal.withColumn("metric", F.lower("metric")).join(F.broadcast(spec), "metric")
    if groups is not None:
        inside = F.broadcast(groups.select(F.col("grp"), F.col("channel"), F.lit(True).alias("inside")))
        hit = hit.join(inside, ["grp", "channel"], "left").filter("grp = '' or inside")
    used = sorted({m.reducer for m in measures})
    agg = hit.groupBy(*keys, "metric", "reducer", "factor", "grp").agg(*[REDUCERS[r](v).alias(f"_{r}") for r in used])
    picked = F.coalesce(*[F.when(F.col("reducer") == r, F.col(f"_{r}")) for r in used])
    return agg.select(*keys, F.concat_ws("/", "metric", "reducer", F.nullif("grp", F.lit(""))).alias("feature"), (picked * F.col("factor")).alias("score"))


def best_density(stats: DataFrame, keys: Sequence[str], by: str = "auc") -> DataFrame:
    """All statistics of each key at the density with the largest `by`, the first of equals."""
    rest = [c for c in stats.columns if c not in keys]
    return stats.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.round(by, 9), -F.col("t_idx"))).alias("b")).select(*keys, "b.*")


def match_thresholds(nodal: DataFrame, wanted: Sequence[float], density: str = "density") -> DataFrame:
    """Rows of the wanted densities, compared as thousandths; a missing one is an error."""
    key = F.round(F.col(density).cast("double") * 1000).cast("int")
    want = sorted({round(w * 1000) for w in wanted})
    there = {r[0] for r in nodal.select(key).distinct().collect()}  # 37 densities at most
    if missing := [w for w in want if w not in there]:
        raise ValueError(f"densities not there: {[w / 1000 for w in missing]}")
    return nodal.filter(key.isin(want))


def power_features(spectrum: DataFrame, bands: DataFrame, keys: Sequence[str] = (), freq: str = "bin") -> DataFrame:
    """Mean and deviation over channels of each band's power and of its share of the channel's bands."""
    from latticework.operators.signal import in_bands, share

    p = in_bands(spectrum, bands, freq).groupBy(*keys, "channel", "band").agg(F.avg("power").alias("power"))
    p = share(p, "power", [*keys, "channel"])
    return p.groupBy(*keys, "band").agg(F.avg("power").alias("power_mean"), F.stddev_samp("power").alias("power_sd"), F.avg("rel").alias("rel_mean"), F.stddev_samp("rel").alias("rel_sd"))


def rejection_report(epochs: DataFrame, keys: Sequence[str], rejected: str = "rejected", seconds: int = 10) -> DataFrame:
    """Epochs kept and rejected, and the kept minutes."""
    bad = F.sum(F.col(rejected).cast("int"))
    return epochs.groupBy(*keys).agg(bad.alias("n_rejected"), (F.count("*") - bad).alias("n_kept"), ((F.count("*") - bad) * seconds / 60.0).alias("minutes"))
