"""The library in SQL: temporary views of tables and of what queries start from, and table functions for graphs and connectivity.

    register(spark, folder)
    spark.sql("SELECT * FROM graph_nodes(TABLE(connectivity) PARTITION BY (label), 0.3)")
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, Row, StringType, StructField, StructType

from latticework.operators.graph import distances
from latticework.operators.signal import tapers
from latticework.operators.spectra import Sums
from latticework.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels")


def analyzed(given: AnalyzeArgument, needed: dict[str, tuple], made: list[tuple[str, object]]) -> AnalyzeResult:
    """The result's columns: all of the table but those that the function reads, then those it makes."""
    if not given.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    fields = {f.name: f for f in given.dataType.fields}
    for name, kinds in needed.items():
        if name not in fields:
            raise ValueError(f"the table needs a column {name}; it has {', '.join(fields)}")
        if kinds and fields[name].dataType.typeName() not in kinds:
            raise ValueError(f"{name} must be {' or '.join(kinds)}, not {fields[name].dataType.simpleString()}")
    kept = [f for f in given.dataType.fields if f.name not in needed]
    clash = {f.name for f in kept} & {name for name, _ in made}
    if clash:
        raise ValueError(f"the table may not have a column {', '.join(sorted(clash))}")
    return AnalyzeResult(StructType([*kept, *[StructField(n, t) for n, t in made]]))


_EDGE = {"i": ("long", "integer", "bigint"), "j": ("long", "integer", "bigint"), "w": ()}


class Graph:
    """The pairs of one partition, and its strongest share as an adjacency matrix; a graph has as many nodes as a montage has channels."""

    def __init__(self):
        self.pairs: list[tuple[float, int, int]] = []
        self.keys: list | None = None
        self.density = 1.0

    def eval(self, row: Row, density: float):
        self.keys = [row[c] for c in row.__fields__ if c not in _EDGE] if self.keys is None else self.keys
        self.density = float(density)
        w = row["w"]
        self.pairs.append((0.0 if w is None or w != w else abs(float(w)), row["i"], row["j"]))

    def matrix(self) -> tuple[list[int], np.ndarray]:
        nodes = sorted({n for _, i, j in self.pairs for n in (i, j)})
        at = {n: k for k, n in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for w, i, j in sorted(self.pairs, key=lambda p: (-p[0], p[1], p[2]))[: int(len(self.pairs) * self.density + 0.5)]:
            a[at[i], at[j]] = a[at[j], at[i]] = w
        return nodes, a


class GraphNodes(Graph):
    """graph_nodes(TABLE(keys, i, j, w) PARTITION BY (keys), density): keys, node, degree, strength and clustering of the strongest share of each partition's pairs."""

    @staticmethod
    def analyze(given: AnalyzeArgument, density: AnalyzeArgument) -> AnalyzeResult:
        return analyzed(given, _EDGE, [("node", LongType()), ("degree", LongType()), ("strength", DoubleType()), ("clustering", DoubleType())])

    def terminate(self):
        if self.keys is None:
            return
        nodes, a = self.matrix()
        b = (a != 0).astype(float)
        degree, triangles = b.sum(axis=1), ((b @ b) * b).sum(axis=1) / 2
        for k, node in enumerate(nodes):
            d = degree[k]
            yield (*self.keys, node, int(d), float(a[k].sum()), float(2 * triangles[k] / (d * (d - 1))) if d > 1 else 0.0)


class GraphSummary(Graph):
    """graph_summary(TABLE(keys, i, j, w) PARTITION BY (keys), density): keys, edges, path_length and efficiency of the strongest share of each partition's pairs; path_length, over pairs that are linked, is null without any."""

    @staticmethod
    def analyze(given: AnalyzeArgument, density: AnalyzeArgument) -> AnalyzeResult:
        return analyzed(given, _EDGE, [("edges", LongType()), ("path_length", DoubleType()), ("efficiency", DoubleType())])

    def terminate(self):
        if self.keys is None:
            return
        nodes, a = self.matrix()
        steps = distances(a)
        steps = steps[~np.eye(len(nodes), dtype=bool)]
        reached = steps[np.isfinite(steps)]
        yield (*self.keys, int((a != 0).sum() // 2), float(reached.mean()) if len(reached) else None, float((1 / reached).sum() / len(steps)) if len(steps) else 0.0)


class PhaseConnectivity:
    """phase_connectivity(TABLE(keys, waves) PARTITION BY (keys), rate, n, smoothing, lo, hi): keys, freq, ch_i, ch_j and w, the
    debiased weighted phase lag index over the partition's rows. A row is an epoch; waves maps its channels to maps of
    sample number to value. Rows are added up as they come, so a partition may have any number of them."""

    @staticmethod
    def analyze(given: AnalyzeArgument, rate: AnalyzeArgument, n: AnalyzeArgument, smoothing: AnalyzeArgument, lo: AnalyzeArgument, hi: AnalyzeArgument) -> AnalyzeResult:
        return analyzed(given, {"waves": ("map",)}, [("freq", DoubleType()), ("ch_i", StringType()), ("ch_j", StringType()), ("w", DoubleType())])

    def __init__(self):
        self.sums: Sums | None = None
        self.names: list[str] = []
        self.keys: list | None = None

    def eval(self, row: Row, rate: float, n: int, smoothing: float, lo: float, hi: float):
        self.keys = [row[c] for c in row.__fields__ if c != "waves"] if self.keys is None else self.keys
        waves = row["waves"] or {}
        new = sorted(set(waves) - set(self.names))
        if new or self.sums is None:
            old, self.names = self.sums, self.names + new
            own = tapers(n, max(1.0, float(smoothing) * n / float(rate)))
            self.sums = Sums(len(self.names), own, 1 << (n - 1).bit_length(), float(rate), float(lo), float(hi))
            if old is not None:  # earlier pairs and channels come first among the larger montage's
                held = np.flatnonzero(self.sums.upper[1] < len(old.seen))
                self.sums.cross[:, :, held], self.sums.together[held] = old.cross, old.together
                self.sums.power[:, : len(old.seen)], self.sums.seen[: len(old.seen)] = old.power, old.seen
        epoch, held = np.zeros((len(self.names), n)), np.zeros((len(self.names), n), bool)
        for k, name in enumerate(self.names):
            for sample, value in (waves.get(name) or {}).items():
                if value is not None and 0 <= sample < n:
                    epoch[k, sample] = value
                    held[k, sample] = True
        self.sums.add(epoch, held)

    def terminate(self):
        if self.sums is None:
            return
        i, j = self.sums.upper
        for freq, (s, a, q) in zip(self.sums.marks.tolist(), self.sums.cross, strict=True):
            for k in np.flatnonzero(self.sums.together).tolist():
                below = a[k] ** 2 - q[k]
                pair = sorted((self.names[i[k]], self.names[j[k]]))
                yield (*self.keys, freq, *pair, float((s[k] ** 2 - q[k]) / below) if below else None)


FUNCTIONS = {"graph_nodes": GraphNodes, "graph_summary": GraphSummary, "phase_connectivity": PhaseConnectivity}


def register_functions(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views of all tables, of samples, recordings (subject, channel, epoch, sample, value) and connectivity (label, i, j, w), and the table functions. Views hold plans, not rows."""
    from latticework.plans import graphs, signals, subjects

    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    signals.samples(spark, sf_dir).createOrReplaceTempView("samples")
    subjects.recordings(spark, sf_dir).createOrReplaceTempView("recordings")
    graphs.conn(spark, sf_dir).createOrReplaceTempView("connectivity")
    register_functions(spark)
