"""All measures of the cohort sweep for every graph at once, and their contrasts between groups at the best density."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import measures as M
from latticework.operators import stats as T
from latticework.operators.graph import _by_graph, communities, distances
from latticework.operators.ranks import pair_ranks

#: Measures by the names of the sweep; those of measures.PRESETS, and the median of medians.
MEASURES = [M.Measure("median", "median") if name == "median" else M.measure(name) for name in M.SWEEP]


def graph_measures(edges: DataFrame, keys: Sequence[str], channels: DataFrame, places: pd.DataFrame, runs: int = 50, seed: int = 1) -> DataFrame:
    """keys, channel, metric, value: degree, clustering, participation coefficient and module of each channel, and with each
    channel the graph's path length, efficiency, modularity and modular span.

    Partitions are those of `runs` seeded community searches, their measures means over them; modules are the first
    run's. places (channel, x, y, z) give the distances of the span. Graphs come as by graph.clustering, channels without
    an edge included; a measure that a graph does not have (a span without an inner edge, a path length without any edge)
    has no row. One grouped call does a graph, so its edges are shuffled once for all measures.
    """
    at = places.set_index("channel")[["x", "y", "z"]]

    def run(p: pd.DataFrame, nodes: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        link = (a != 0).astype(float)
        k, m2, n = link.sum(axis=1), link.sum(), len(link)
        steps = distances(a)[~np.eye(n, dtype=bool)]
        reached = steps[np.isfinite(steps)]
        xyz = at.reindex(nodes).to_numpy()
        apart = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
        q, spans, shares, first = [], [], [], None
        for r in range(runs):
            c = communities(link, seed * 1_000_003 + r)
            first = c if first is None else first
            own = np.eye(c.max() + 1)[c]
            into = link @ own
            q.append(((link - np.outer(k, k) / m2) * (c[:, None] == c[None])).sum() / m2 if m2 else 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                shares.append(np.where(k > 0, 1 - ((into / k[:, None]) ** 2).sum(axis=1), 0.0))
            size, inner = own.sum(axis=0), np.einsum("ik,ij,jk->k", own, np.nan_to_num(apart) * link, own) / 2
            held = (size > 1) & (inner != 0)
            if held.any():
                spans.append((inner[held] / size[held]).max())
        triangles = ((link @ link) * link).sum(axis=1) / 2
        own = {"degree": k, "clustering": np.where(k > 1, 2 * triangles / np.maximum(1, k * (k - 1)), 0.0), "participation coefficient": np.mean(shares, axis=0), "modules": first + 1.0}
        whole = {"modularity": np.mean(q), "efficiency": (1 / reached).sum() / len(steps) if len(steps) else 0.0}
        whole |= {"characteristic path length": reached.mean()} if len(reached) else {}
        whole |= {"modular span": np.mean(spans)} if spans else {}
        names, values = zip(*own.items(), *((name, np.full(n, v)) for name, v in whole.items()), strict=True)
        return pd.DataFrame({"channel": list(nodes) * len(names), "metric": np.repeat(names, n), "value": np.concatenate(values)})

    kind = dict(channels.dtypes)["node"]
    return _by_graph(edges, keys, channels, run, f"channel {kind}, metric string, value double")


def median_rows(conn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, channel, metric, value: each channel's median connectivity with all channels, itself at 0, as a matrix with a zero diagonal has it."""
    both = conn.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("channel"), "w"), F.struct(F.col("j").alias("channel"), "w"))).alias("e")).select(*keys, "e.*")
    rows = both.groupBy(*keys, "channel").agg(F.concat(F.collect_list(F.nanvl("w", F.lit(0.0))), F.array(F.lit(0.0))).alias("row"))  # as many as a montage has channels
    middle = F.sort_array("row")
    n = F.size("row")
    return rows.select(*keys, "channel", F.lit("median").alias("metric"), ((F.get(middle, ((n - 1) / 2).cast("int")) + F.get(middle, (n / 2).cast("int"))) / 2).alias("value"))


def contrasts(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each pair of groups' AUC, U and rank-sum p (exact for small groups) of every feature, at the density of the largest AUC; scores (keys, t_idx, subject, feature, grp, score)."""
    from latticework.functions.scalar import normal_two_sided

    own = [*keys, "feature", "t_idx"]
    st = T.rank_statistics(pair_ranks(scores, own), own).withColumn("p", F.coalesce("exact_p", normal_two_sided("z")))
    return M.best_density(st.select(*keys, "feature", "g0", "g1", "t_idx", "auc", "u_min", "n0", "n1", "p"), [*keys, "feature", "g0", "g1"])
