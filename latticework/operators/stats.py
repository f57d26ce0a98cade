"""Group statistics over scores(feature..., grp, score): ranks, AUC, thresholds, contingency, trend, discovery rates, permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.ranks import pair_ranks
from latticework.operators.selection import median

Keys = Sequence[str]


def group_pairs(df: DataFrame, grp: str = "grp") -> DataFrame:
    """Unordered pairs g0 < g1 of the few groups."""
    g = df.select(grp).filter(F.col(grp).isNotNull()).distinct()
    return g.select(F.col(grp).alias("g0")).join(F.broadcast(g.select(F.col(grp).alias("g1"))), F.col("g0") < F.col("g1"))


def value_counts(df: DataFrame, keys: Keys, grp: str = "grp", score: str = "score") -> DataFrame:
    """Rows of each group at each value: what rank statistics need, however many rows tie."""
    return df.filter(F.col(score).isNotNull() & F.col(grp).isNotNull()).groupBy(*keys, grp, score).agg(F.count("*").cast("double").alias("n"))


def pair_counts(counts: DataFrame, pairs: DataFrame, keys: Keys, grp: str = "grp", score: str = "score") -> DataFrame:
    """What the ranks of each pair of groups tell, from counts of equal values; see ranks.pair_ranks."""
    return pair_ranks(counts, keys, grp, score, "n", pairs)


def rank_statistics(pr: DataFrame, keys: Keys) -> DataFrame:
    """n0, n1, u (of the higher group), auc (folded), u_min, the tie-corrected z and, of small groups, exact_p of each pair."""
    n, n01 = F.col("n0") + F.col("n1"), F.col("n0") * F.col("n1")
    auc = F.col("u") / n01
    var = n01 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    z = (F.col("u") - n01 / 2) / F.nullif(F.sqrt(var), F.lit(0.0))
    return pr.select(*keys, "g0", "g1", "n0", "n1", "u", F.greatest(auc, 1 - auc).alias("auc"), F.least(F.col("u"), n01 - F.col("u")).alias("u_min"), z.alias("z"), "exact_p")


def youden(pr: DataFrame, keys: Keys) -> DataFrame:
    """The score whose |TPR - FPR|, of rows at it or above, is largest, the larger of equals, and the confusion of strictly higher scores."""
    j = F.round(F.abs(F.col("tp_at") / F.col("n1") - F.col("fp_at") / F.col("n0")), 9)
    fp, tp = F.col("fp_at") - F.col("at0"), F.col("tp_at") - F.col("at1")
    return pr.select(*keys, "g0", "g1", "threshold", j.alias("j"), (F.col("n0") - fp).alias("tn"), fp.alias("fp"), (F.col("n1") - tp).alias("fn"), tp.alias("tp"))


def contingency(df: DataFrame) -> DataFrame:
    """Adds chi2 (Pearson) and accuracy (%) to tn, fp, fn, tp."""
    a, b, c, d = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = a + b + c + d
    return df.withColumn("chi2", n * (a * d - b * c) ** 2 / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))).withColumn("accuracy", 100.0 * (a + d) / n)


def jonckheere(counts: DataFrame, keys: Keys, grp: str = "grp", score: str = "score") -> DataFrame:
    """The trend statistic over all group pairs g0 < g1 (ties count half) and its z, without the correction for ties."""
    stats = rank_statistics(pair_counts(counts, group_pairs(counts, grp), keys, grp, score), keys)
    jt = stats.groupBy(*keys).agg(F.sum("u").alias("jt"))
    size = counts.groupBy(*keys, grp).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("n2"), F.sum(F.col("n") ** 2 * (2 * F.col("n") + 3)).alias("n3"))
    keyed = jt.join(size, list(keys)) if keys else jt.crossJoin(size)
    return keyed.select(*keys, "jt", ((F.col("jt") - (F.col("n") ** 2 - F.col("n2")) / 4) / F.nullif(F.sqrt((F.col("n") ** 2 * (2 * F.col("n") + 3) - F.col("n3")) / 72), F.lit(0.0))).alias("z"))


def discovery_threshold(df: DataFrame, p: str, alpha: float = 0.05, keys: Keys = ()) -> DataFrame:
    """Adds fdr: the largest p not above alpha times its rank over the number of tests, jointly for each key; 0 if none."""
    part = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.rank().over(part.orderBy(p)) + F.count("*").over(part.orderBy(p).rangeBetween(0, 0)) - 1).withColumn("_m", F.count("*").over(part))
    fits = F.when(F.col(p) <= alpha * F.col("_i") / F.col("_m"), F.col(p))
    return ranked.withColumn("fdr", F.coalesce(F.max(fits).over(part), F.lit(0.0))).drop("_i", "_m")


def tiers(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """tier 2 at or below the discovery threshold, 1 below alpha; the rest goes."""
    return df.withColumn("tier", F.when((F.col(p) <= F.col("fdr")) & (F.col("fdr") > 0), 2).when(F.col(p) < alpha, 1)).filter("tier is not null")


def top(df: DataFrame, by: str, n: int, tie: str, keys: Keys = ()) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), tie))).filter(F.col("rank") <= n)


def mean_sem(df: DataFrame, value: str, keys: Keys) -> DataFrame:
    """Mean, and the standard error over all rows, missing ones counted as the reference measure does."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("sem"))


def median_of_medians(df: DataFrame, value: str, inner: Keys, outer: Keys) -> DataFrame:
    """The median over inner keys, each a unit of a few values, by Spark's own function; then over units, which may be any number, by exact selection."""
    first = df.groupBy(*outer, *inner).agg(F.median(value).alias("m"))
    return median(first, "m", outer)


def hashed(units: np.ndarray, perms: np.ndarray, seed: int = 1) -> np.ndarray:
    """A number from 0 to 1 for each permutation and unit, the same wherever it is computed."""
    z = units.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + perms.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def permuted_differences(df: DataFrame, value: str, features: Keys, perms: int = 200, seed: int = 1) -> DataFrame:
    """perm, features, diff: the groups' mean difference (grp 0 or 1) with units dealt anew, perm 0 as observed.

    Rows (unit, grp, features, value) keep their unit's features together. Each permutation gives a unit to group 0 with
    the chance of group 0's share, by a hash of unit and permutation, so no unit meets another and nothing is sorted; the
    groups' sizes then vary as a toss does. A batch's values times its units' memberships is one matrix product; what is
    shuffled is a row for each task, feature and permutation.
    """
    n = {r["grp"]: r["count"] for r in df.select("unit", "grp").distinct().groupBy("grp").count().collect()}  # two rows
    if set(n) != {0, 1}:
        raise ValueError("two conditions, 0 and 1, are needed")
    share = n[0] / (n[0] + n[1])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        every = np.arange(1, perms + 1)
        for p in batches:
            p = p[p[value].notna()]
            for key, g in p.groupby(list(features)):
                x = g[value].to_numpy(float)
                h = hashed(g["unit"].to_numpy(np.int64), every, seed) < share
                own = np.vstack([(g["grp"].to_numpy() == 0)[None], h]).astype(float)
                total[key] = total.get(key, 0) + np.stack([own @ x, own.sum(axis=1), np.full(perms + 1, x.sum()), np.full(perms + 1, float(len(x)))])
        for key, (s, c, all_s, all_c) in total.items():
            yield pd.DataFrame({**{k: [v] * (perms + 1) for k, v in zip(features, key, strict=True)}, "perm": np.arange(perms + 1), "s": s, "c": c, "all_s": all_s, "all_c": all_c})

    schema = ", ".join(f"{k} {kinds[k]}" for k in features) + ", perm int, s double, c double, all_s double, all_c double"
    per = df.select("unit", "grp", *features, value).mapInPandas(sums, schema).groupBy("perm", *features).agg(*[F.sum(c).alias(c) for c in ("s", "c", "all_s", "all_c")])
    none = F.lit(0.0)
    return per.select("perm", *features, (F.col("s") / F.nullif("c", none) - (F.col("all_s") - F.col("s")) / F.nullif(F.col("all_c") - F.col("c"), none)).alias("diff"))


def max_statistic(diffs: DataFrame, features: Keys) -> DataFrame:
    """Each feature's observed difference and the share of permutations, the observed one included, whose largest difference reaches it."""
    peaks = diffs.groupBy("perm").agg(F.max(F.abs("diff")).alias("peak")).agg(F.collect_list("peak").alias("peaks"))  # one number per permutation
    seen = diffs.filter("perm = 0").join(F.broadcast(peaks))
    return seen.select(*features, "diff", (F.size(F.filter("peaks", lambda x: x >= F.abs(F.col("diff")))) / F.size("peaks")).alias("p"))


def exact_rank_sum_p(n0: int, n1: int, u: float) -> float:
    """Two-sided exact p of U without ties, by counting subsets; for small groups."""
    ways = np.zeros((n1 + 1, n0 * n1 + 1))
    ways[0, 0] = 1
    for item in range(n0 + n1):
        for k in range(min(n1, item + 1), 0, -1):
            shift = item - (k - 1)
            if shift <= n0 * n1:
                ways[k, shift:] += ways[k - 1, : n0 * n1 + 1 - shift]
    tail = ways[n1, : int(min(u, n0 * n1 - u)) + 1].sum() / ways[n1].sum()
    return float(min(1.0, 2 * tail))


def chosen_pairs(df: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    return df.filter(F.struct("g0", "g1").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs]))

