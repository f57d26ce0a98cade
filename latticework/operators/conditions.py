"""Two conditions of a recording: debiased wPLI differences under permuted epochs, and the network-based statistic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators.graph import network_components
from latticework.session import kept

Keys = Sequence[str]


def dealt(epochs: DataFrame, keys: Keys = (), perms: int = 200, seed: int = 1) -> DataFrame:
    """keys, epoch, member: a bit for each permutation, 0 being as observed, set where the epoch belongs to condition 0.

    epochs(keys, epoch, condition) are those of a recording, some hundreds; both conditions (0 and 1) need as many.
    """
    kinds = {f.name: f.dataType.simpleString() for f in epochs.schema}

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["condition", "epoch"])
        first = (p["condition"] == 0).to_numpy()
        if 2 * first.sum() != len(p):
            raise ValueError("both conditions need the same number of epochs")
        bits = np.stack([first] + [np.random.default_rng([seed, k]).permutation(first) for k in range(1, perms + 1)], axis=1)
        return p[[*keys, "epoch"]].assign(member=[b.tobytes() for b in np.packbits(bits, axis=1)])

    own = epochs.select(*keys, "epoch", "condition").distinct()
    return own.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "epoch"]) + ", member binary")


def permuted_wpli(csd: DataFrame, epochs: DataFrame, keys: Keys = (), perms: int = 200, seed: int = 1) -> DataFrame:
    """keys, ch_i, ch_j, perm, diff: a pair's debiased wPLI in condition 0 less that in condition 1, each at its own peak.

    csd(keys, epoch, bin, ch_i, ch_j, im) holds the bins of one band; a side's peak is the bin where its mean over pairs is
    largest, the first of equals, for each permutation anew. A task holds one channel's pairs at one bin: its epochs'
    sums for all permutations are matrix products, which are written and read for the peaks and for the pairs. Only means of bins are shuffled for each permutation, then the two
    values that each pair needs of it. A pair without a value at a peak has none there.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in csd.schema}

    def one(p: pd.DataFrame) -> pd.DataFrame:
        member = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in p["member"]]), axis=1)[:, : perms + 1].astype(float)
        im, out = p["im"].to_numpy(float), []
        for other, at in p.groupby("ch_j").indices.items():
            x, sides = np.stack([im[at], np.abs(im[at]), im[at] ** 2]), []
            for m in (member[at], 1 - member[at]):
                s, a, q = x @ m
                sides.append(np.divide(s * s - q, a * a - q, out=np.full(perms + 1, np.nan), where=np.abs(a * a - q) > 1e-12 * a * a))
            out.append((other, *sides))
        return pd.DataFrame(out, columns=["ch_j", "w0", "w1"]).assign(**{k: p[k].iloc[0] for k in [*keys, "bin", "ch_i"]})[[*keys, "bin", "ch_i", "ch_j", "w0", "w1"]]

    rows = csd.select(*keys, "epoch", "bin", "ch_i", "ch_j", "im").join(dealt(epochs, keys, perms, seed), [*keys, "epoch"])
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "bin", "ch_i", "ch_j"]) + ", w0 array<double>, w1 array<double>"
    each = kept(rows.groupBy(*keys, "bin", "ch_i").applyInPandas(one, schema), "permuted")
    none = F.lit(None).cast("double")
    means = each.select(*keys, "bin", F.posexplode(F.arrays_zip("w0", "w1")).alias("perm", "w")).groupBy(*keys, "bin", "perm").agg(*[r9(F.avg(F.nanvl(f"w.w{s}", none))).alias(f"m{s}") for s in (0, 1)])
    peaks = means.groupBy(*keys, "perm").agg(*[F.max_by("bin", F.struct(f"m{s}", (-F.col("bin")).alias("b"))).alias(f"b{s}") for s in (0, 1)])
    sides = F.array(*[F.struct(F.col(f"b{s}").alias("bin"), F.lit(s).alias("side")) for s in (0, 1)])
    wanted = peaks.select(*keys, "perm", F.explode(sides).alias("p")).groupBy(*keys, "p.bin").agg(F.collect_list(F.struct("perm", "p.side")).alias("wanted"))  # two for each permutation
    hit = each.join(wanted, [*keys, "bin"]).select(*keys, "ch_i", "ch_j", "w0", "w1", F.explode("wanted").alias("p"))
    value = F.when(F.col("p.side") == 0, F.get("w0", F.col("p.perm"))).otherwise(-F.get("w1", F.col("p.perm")))
    both = hit.select(*keys, "ch_i", "ch_j", "p.perm", value.alias("v")).groupBy(*keys, "ch_i", "ch_j", "perm").agg(F.sum("v").alias("v"), F.count("v").alias("n"))
    return both.filter("n = 2").select(*keys, "ch_i", "ch_j", "perm", F.nanvl("v", none).alias("diff"))


def one_sided(diffs: DataFrame, keys: Keys = ()) -> DataFrame:
    """Observed differences with p, the share of permutations, the observed one included, whose largest difference reaches them."""
    keys = list(keys)
    largest = diffs.groupBy(*keys, "perm").agg(F.max("diff").alias("peak")).groupBy(*keys).agg(F.collect_list("peak").alias("peaks"))  # a number for each permutation
    seen = diffs.filter("perm = 0")
    seen = seen.join(largest, keys) if keys else seen.crossJoin(largest)
    return seen.select(*keys, "ch_i", "ch_j", "diff", (F.size(F.filter("peaks", lambda x: x >= F.col("diff"))) / F.size("peaks")).alias("p"))


def network_statistic(diffs: DataFrame, alpha: float = 0.05, keys: Keys = (), perms: int = 200) -> DataFrame:
    """keys, component, nodes, intensity, p of the observed network's components.

    The threshold is the smallest positive difference with one-sided p below alpha; no such difference, no component.
    Intensity sums what the edges have above it; p is the share of permutations whose largest component reaches it.
    """
    keys = list(keys)
    limit = one_sided(diffs, keys).filter((F.col("diff") > 0) & (F.col("p") < alpha)).groupBy(*keys).agg(F.min("diff").alias("limit"))  # a row for each recording
    above = diffs.join(limit, keys) if keys else diffs.crossJoin(limit)
    edges = above.filter("diff > limit").select(*keys, "perm", F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), (F.col("diff") - F.col("limit")).alias("w"))
    parts = network_components(edges, [*keys, "perm"])
    chance = parts.filter("perm > 0").groupBy(*keys, "perm").agg(F.max("intensity").alias("peak")).groupBy(*keys).agg(F.collect_list("peak").alias("peaks"))
    seen = parts.filter("perm = 0")
    seen = seen.join(chance, keys, "left") if keys else seen.crossJoin(chance)
    reach = F.size(F.filter(F.coalesce("peaks", F.array().cast("array<double>")), lambda x: x >= F.col("intensity")))
    return seen.select(*keys, "component", "nodes", "intensity", (reach / F.lit(float(perms))).alias("p"))
