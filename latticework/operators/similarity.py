"""Similarity of every pair of subjects' partitions by blocks of one-hot matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subjects in a block; two blocks' contingency tables are made together, PIECE subjects of the one at a time.
BLOCK, PIECE = 512, 32


def one_hot(modules: list[dict[int, int]], nodes: dict[int, int]) -> tuple[np.ndarray, int]:
    """Subjects times modules by nodes, and the number of modules: 1 where the subject has the node in the module."""
    codes = {m: k for k, m in enumerate(sorted({m for own in modules for m in own.values()}))}
    out = np.zeros((len(modules), len(codes), len(nodes)))
    for s, own in enumerate(modules):
        for node, m in own.items():
            out[s, codes[m], nodes[node]] = 1
    return out.reshape(-1, len(nodes)), len(codes)


def table_nmi(tables: np.ndarray) -> np.ndarray:
    """2 I / (H1 + H2) of contingency tables (..., m1, m2); 1 where both sides have one part, NaN where a table is empty."""
    n = tables.sum(axis=(-2, -1), keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = tables / n
        px, py = p.sum(axis=-1, keepdims=True), p.sum(axis=-2, keepdims=True)
        i = np.where(p > 0, p * np.log(p / (px * py)), 0.0).sum(axis=(-2, -1))
        h = np.where(px > 0, -px * np.log(px), 0.0).sum(axis=(-2, -1)) + np.where(py > 0, -py * np.log(py), 0.0).sum(axis=(-2, -1))
        return np.where(n[..., 0, 0] == 0, np.nan, np.where(h <= 0, 1.0, 2 * i / h))


def subject_pairs_nmi(df: DataFrame, keys: Sequence[str] = (), subject: str = "subject", block: int = BLOCK) -> DataFrame:
    """keys, s1, s2, nmi of every pair s1 < s2 of subjects that share a node, from df(keys, subject, node, module).

    A subject's partition is one row: a module for each node of a montage. Subjects are dealt to blocks by a hash, and
    each pair of blocks meets once: the product of their one-hot matrices holds all contingency tables of the pair. No
    subject meets another on a node, so a node that all subjects have makes no hot key, and a task holds two blocks
    whatever the number of subjects. A node listed twice for a subject counts once, in the larger module; nulls of
    subject, node and module take no part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.filter(F.col(subject).isNotNull() & F.col("node").isNotNull() & F.col("module").isNotNull())
    once = rows.groupBy(*keys, subject, F.col("node").cast("long").alias("node")).agg(F.max(F.col("module").cast("long")).alias("module"))
    own = once.groupBy(*keys, F.col(subject).alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("node", "module"))).alias("_m"))
    blocks = rows.agg(F.approx_count_distinct(subject)).collect()[0][0] // block + 1
    dealt = own.withColumn("_b", F.pmod(F.xxhash64("_s"), F.lit(blocks)).cast("int"))
    all_of = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.withColumn("_j", F.explode(F.filter(all_of, lambda j: j >= F.col("_b")))).withColumnRenamed("_b", "_i")
    right = dealt.withColumn("_i", F.explode(F.filter(all_of, lambda i: i <= F.col("_b")))).withColumnRenamed("_b", "_j")
    right = right.select(*[F.col(c).alias(c) for c in left.columns])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            names_a, names_b = a["_s"].to_pylist(), b["_s"].to_pylist()
            maps_a, maps_b = ([dict(m) for m in t["_m"].to_pylist()] for t in (a, b))
            nodes = {n: k for k, n in enumerate(sorted({n for m in (*maps_a, *maps_b) for n in m}))}
            y, m2 = one_hot(maps_b, nodes)
            same = a["_i"][0].as_py() == a["_j"][0].as_py()
            for at in range(0, len(names_a), PIECE):
                x, m1 = one_hot(maps_a[at : at + PIECE], nodes)
                tables = (x @ y.T).reshape(-1, m1, len(names_b), m2).transpose(0, 2, 1, 3)
                nmi = table_nmi(tables)
                for r, s in enumerate(names_a[at : at + PIECE]):
                    for c, t in enumerate(names_b):
                        if s != t and (s < t or not same) and nmi[r, c] == nmi[r, c]:
                            found.append((min(s, t), max(s, t), float(nmi[r, c])))
        head = {k: pa.array([(a if a.num_rows else b)[k][0].as_py()] * len(found), a[k].type) for k in keys}
        kind = a["_s"].type
        return pa.table({**head, "s1": pa.array([f[0] for f in found], kind), "s2": pa.array([f[1] for f in found], kind), "nmi": pa.array([f[2] for f in found], pa.float64())})

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + f"s1 {kinds[subject]}, s2 {kinds[subject]}, nmi double"
    return left.groupBy(*keys, "_i", "_j").cogroup(right.groupBy(*keys, "_i", "_j")).applyInArrow(run, schema)
