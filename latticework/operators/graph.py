"""Connectivity and graph measures over conn(keys, i, j, w) and edges(keys, i, j, w), i < j."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.scalar import missing_to_zero, r9

Keys = Sequence[str]


def correlations(df: DataFrame, vector: str, keys: Keys) -> DataFrame:
    """Pearson correlation of every pair of vector positions, by key; null where a position doesn't vary.

    Each task adds up its rows per key in numpy as a count, means and centred products, so values far from 0 cost no
    digits; what is shuffled is a block per task and key, and blocks are merged as they stream by, by the difference of
    their means. Rows with a null or NaN component take no part, nor do vectors shorter than their key's longest.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    own = "".join(f"{k} {fields[k]}, " for k in keys)
    whole = df.select(*keys, F.transform(vector, lambda c: c.cast("double")).alias("_v")).filter(F.col("_v").isNotNull() & (F.size("_v") > 1) & ~F.exists("_v", lambda c: c.isNull() | F.isnan(c)))

    def merged(x: tuple, y: tuple) -> tuple:
        (n, m, c), (k, p, d) = x, y
        apart = p - m
        return n + k, m + apart * (k / (n + k)), c + d + np.outer(apart, apart) * (n * k / (n + k))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            lengths = b.column("_v").value_lengths().to_numpy()
            flat, at = b.column("_v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            rows: dict = {}
            for r, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys), lengths.tolist(), strict=True)):
                rows.setdefault(key, []).append(r)
            for key, held in rows.items():
                x = flat[at[held][:, None] + np.arange(key[-1])[None]]
                mean = x.mean(axis=0)
                block = len(x), mean, (x - mean).T @ (x - mean)
                sums[key] = merged(sums[key], block) if key in sums else block
        for key, (n, m, c) in sums.items():
            packed = np.concatenate([[float(n)], m, c.ravel()]).tobytes()
            yield pa.RecordBatch.from_arrays([*[pa.array([v], b.column(k).type) for k, v in zip(keys, key[:-1], strict=True)], pa.array([key[-1]], pa.int32()), pa.array([packed], pa.binary())], [*keys, "_d", "block"])

    parts = whole.mapInArrow(partial, own + "_d int, block binary").withColumn("_key", F.xxhash64(F.lit(0), *keys))
    ordered = parts.repartition("_key").sortWithinPartitions("_key", F.desc("_d"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = names = None
        wide = 0

        def out() -> pa.RecordBatch:
            _, _, c = total
            i, j = np.triu_indices(wide, 1)
            spread = np.sqrt(np.maximum(np.diag(c), 0))
            below = spread[i] * spread[j]
            w = np.divide(c[i, j], below, out=np.zeros(len(i)), where=below > 0)
            return pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(v, t), len(i)) for v, t in names], pa.array(i), pa.array(j), pa.array(w, mask=below <= 0)], [*keys, "i", "j", "w"])

        for b in batches:
            for r in range(b.num_rows):
                mine, d = b.column("_key")[r].as_py(), b.column("_d")[r].as_py()
                if mine == key and d < wide:
                    continue
                flat = np.frombuffer(b.column("block")[r].as_py())
                block = flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)
                if mine == key:
                    total = merged(total, block)
                    continue
                if key is not None:
                    yield out()
                key, wide, total, names = mine, d, block, [(b.column(k)[r].as_py(), b.column(k).type) for k in keys]
        if key is not None:
            yield out()

    return ordered.mapInArrow(finished, own + "i long, j long, w double").select(*keys, "i", "j", r9(F.col("w")).alias("w"))


def ranked(conn: DataFrame, keys: Keys, size: bool = True) -> DataFrame:
    """Edges by falling strength: missing to 0, then absolute (unless size is off); rank and n, the number of pairs. Rank once, cut for any density."""
    w = F.abs(missing_to_zero(F.col("w"))) if size else missing_to_zero(F.col("w"))
    part = Window.partitionBy(*keys)
    return conn.withColumn("w", w).withColumn("rank", F.row_number().over(part.orderBy(F.desc("w"), "i", "j"))).withColumn("n", F.count("*").over(part))


def cut(ranks: DataFrame, density: Column | float) -> DataFrame:
    """The strongest share of the pairs; edges of weight 0 never stay."""
    d = density if isinstance(density, Column) else F.lit(density)
    return ranks.filter((F.col("rank") <= F.round(F.col("n") * d)) & (F.col("w") != 0))


def sweep(ranks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Edges of every density: one ranking, joined with the few thresholds."""
    return ranks.join(F.broadcast(thresholds), (F.col("rank") <= F.round(F.col("n") * F.col("density").cast("double"))) & (F.col("w") != 0))


def both_ways(edges: DataFrame, keys: Keys) -> DataFrame:
    """keys, a, b, w for either direction: one scan, no union."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    return edges.select(*keys, ends.alias("e"), "w").select(*keys, "e.a", "e.b", "w")


def nodes(conn: DataFrame, keys: Keys) -> DataFrame:
    """keys, node: all channels that any pair of the graph names, linked or not."""
    return conn.select(*keys, F.explode(F.array("i", "j")).alias("node")).distinct()


def degree(edges: DataFrame, keys: Keys, channels: DataFrame) -> DataFrame:
    """Number of each channel's edges; 0 for those without."""
    d = both_ways(edges, keys).groupBy(*keys, F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return channels.join(d, [*keys, "node"], "left").select(*keys, "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def strength(conn: DataFrame, keys: Keys) -> DataFrame:
    """Sum of a node's weights over the number of its pairs."""
    return both_ways(conn, keys).groupBy(*keys, F.col("a").alias("node")).agg((F.sum("w") / F.count("*")).alias("strength"))


def clustering(edges: DataFrame, keys: Keys, channels: DataFrame) -> DataFrame:
    """Share of a node's neighbour pairs that are linked; 0 below two neighbours, and for channels without an edge."""
    keys = list(keys)
    ab = edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"))
    bc = edges.select(*keys, F.col("i").alias("b"), F.col("j").alias("c"))
    ac = edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("c"))
    corners = ab.join(bc, [*keys, "b"]).join(ac, [*keys, "a", "c"])
    triangles = corners.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("t"))
    d = degree(edges, keys, channels).join(triangles, [*keys, "node"], "left")
    k = F.col("degree")
    return d.select(*keys, "node", "degree", F.when(k < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).alias("clustering"))


def _by_graph(edges: DataFrame, keys: Keys, channels: DataFrame, run, schema: str) -> DataFrame:
    """run(graph's edges, nodes, adjacency matrix) for each key, nodes without an edge and graphs without one included; a graph has as many nodes as a montage has channels."""
    kinds = {f.name: f.dataType.simpleString() for f in channels.schema}

    def one(n: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(n):
            return pd.DataFrame(columns=[*keys, *names])
        own = np.sort(n["node"].to_numpy())
        a = np.zeros((len(own), len(own)))
        i, j = np.searchsorted(own, p["i"].to_numpy()), np.searchsorted(own, p["j"].to_numpy())
        a[i, j] = a[j, i] = p["w"].to_numpy()
        out = run(p, own, a)
        return out.assign(**{k: n[k].iloc[0] for k in keys})[[*keys, *names]]

    return channels.groupBy(*keys).cogroup(edges.select(*[F.col(k).alias(k) for k in keys], "i", "j", "w").groupBy(*keys)).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def distances(a: np.ndarray) -> np.ndarray:
    """Steps between all nodes, by growing the reach one step at a time; inf beyond."""
    link = a != 0
    d = np.where(np.eye(len(a), dtype=bool), 0.0, np.inf)
    reach, step = np.eye(len(a), dtype=bool), 0
    while True:
        step += 1
        grown = (reach.astype(np.float32) @ link.astype(np.float32) > 0) & np.isinf(d)
        if not grown.any():
            return d
        d[grown], reach = step, grown


def shortest_paths(edges: DataFrame, keys: Keys, channels: DataFrame) -> DataFrame:
    """keys, s, t, d for every reachable ordered pair of different nodes."""

    def run(p, nodes, a):
        d = distances(a)
        s, t = np.nonzero(np.isfinite(d) & (d > 0))
        return pd.DataFrame({"s": nodes[s], "t": nodes[t], "d": d[s, t].astype(int)})

    return _by_graph(edges, keys, channels, run, "s long, t long, d long")


def path_length(paths: DataFrame, keys: Keys) -> DataFrame:
    """Mean distance over the reachable pairs."""
    return paths.groupBy(*keys).agg(F.avg("d").alias("path_length"))


def efficiency(paths: DataFrame, keys: Keys, channels: DataFrame) -> DataFrame:
    """Mean inverse distance over all ordered pairs of channels; unreachable ones count 0."""
    near = paths.groupBy(*keys).agg(F.sum(1.0 / F.col("d")).alias("near"))
    n = F.count("*")
    all_pairs = channels.groupBy(*keys).agg((n * (n - 1)).cast("double").alias("pairs"))
    return all_pairs.join(near, list(keys), "left").select(*keys, (F.coalesce("near", F.lit(0.0)) / F.nullif("pairs", F.lit(0.0))).alias("efficiency"))


def betweenness(edges: DataFrame, keys: Keys, channels: DataFrame) -> DataFrame:
    """Shortest paths through each node, over ordered pairs, from path counts per distance layer."""

    def run(p, nodes, a):
        link, d = (a != 0).astype(float), distances(a)
        total = np.zeros(len(nodes))
        for s in range(len(nodes)):
            layer = d[s]
            last = int(layer[np.isfinite(layer)].max())
            count = (layer == 0).astype(float)
            for k in range(1, last + 1):
                count += np.where(layer == k, link @ np.where(layer == k - 1, count, 0), 0)
            owed = np.zeros(len(nodes))
            for k in range(last, 0, -1):
                here = np.where(layer == k, (1 + owed) / np.where(count > 0, count, 1), 0)
                owed += np.where(layer == k - 1, count * (link @ here), 0)
            owed[s] = 0
            total += owed
        return pd.DataFrame({"node": nodes, "betweenness": total})

    return _by_graph(edges, keys, channels, run, "node long, betweenness double")


def communities(a: np.ndarray, seed: int) -> np.ndarray:
    """Module of each node by repeated local moves and merging that raise modularity, in a seeded order."""
    rng = np.random.default_rng(seed)
    member, m2 = np.arange(len(a)), a.sum()
    graph = a.copy()
    while m2 > 0:
        n, k = len(graph), graph.sum(axis=1)
        own, moved = np.arange(n), False
        total = k.copy()
        for _ in range(100):
            changed = False
            for v in rng.permutation(n):
                row = np.bincount(own, graph[v], n)
                row[own[v]] -= graph[v, v]
                total[own[v]] -= k[v]
                gain = row - total * k[v] / m2
                best = int(np.argmax(gain))
                if gain[best] > gain[own[v]] + 1e-12:
                    own[v], changed, moved = best, True, True
                total[own[v]] += k[v]
            if not changed:
                break
        own = np.unique(own, return_inverse=True)[1]
        member = own[member]
        if not moved or own.max() + 1 == n:
            break
        hot = np.eye(own.max() + 1)[own]
        graph = hot.T @ graph @ hot
    return member


def louvain(edges: DataFrame, keys: Keys, channels: DataFrame, runs: int = 50, seed: int = 1) -> DataFrame:
    """keys, run, node, module and q, the run's modularity, on binary edges; a channel without an edge is a module of its own. Every run has a seed of its own, so runs agree anywhere."""

    def run(p, nodes, a):
        out, link = [], (a != 0).astype(float)
        k, m2 = link.sum(axis=1), link.sum()
        for r in range(runs):
            c = communities(link, seed * 1_000_003 + r)
            same = c[:, None] == c[None]
            out.append(pd.DataFrame({"run": r, "node": nodes, "module": c + 1, "q": float(((link - np.outer(k, k) / m2) * same).sum() / m2) if m2 else 0.0}))
        return pd.concat(out)

    return _by_graph(edges, keys, channels, run, "run int, node long, module int, q double")


def modularity(edges: DataFrame, modules: DataFrame, keys: Keys) -> DataFrame:
    """Q of a given partition modules(keys, node, module)."""
    keys = list(keys)
    adj = both_ways(edges, keys)
    m = modules.select(*keys, F.col("node").alias("a"), F.col("module").alias("ma"))
    n = modules.select(*keys, F.col("node").alias("b"), F.col("module").alias("mb"))
    per = adj.join(m, [*keys, "a"]).join(n, [*keys, "b"]).groupBy(*keys, "ma").agg(F.count("*").cast("double").alias("k"), F.sum(F.when(F.col("ma") == F.col("mb"), 1.0).otherwise(0.0)).alias("inside"))
    total = F.sum("k").over(Window.partitionBy(*keys))
    return per.select(*keys, (F.col("inside") / total - (F.col("k") / total) ** 2).alias("part")).groupBy(*keys).agg(F.sum("part").alias("q"))


def participation(edges: DataFrame, modules: DataFrame, keys: Keys, runs: Keys = ()) -> DataFrame:
    """1 less the squared shares of a node's edges over modules(keys, runs, node, module); 0 for nodes without an edge. Partitions of several runs share the edges."""
    keys, own = list(keys), [*keys, *runs]
    m = modules.select(*own, F.col("node").alias("b"), "module")
    per = both_ways(edges, keys).join(m, [*keys, "b"]).groupBy(*own, F.col("a").alias("node"), "module").agg(F.count("*").cast("double").alias("k"))
    p = per.groupBy(*own, "node").agg((1 - F.sum(F.col("k") ** 2) / F.sum("k") ** 2).alias("p"))
    return modules.select(*own, "node").join(p, [*own, "node"], "left").select(*own, "node", F.coalesce("p", F.lit(0.0)).alias("participation"))


def modular_span(edges: DataFrame, modules: DataFrame, dist: DataFrame, keys: Keys, runs: Keys = ()) -> DataFrame:
    """The largest over modules of the summed distance of the edges inside over the module's size; null without such edges."""
    keys, own = list(keys), [*keys, *runs]
    mi, mj = (modules.select(*own, F.col("node").alias(x), F.col("module").alias(f"m{x}")) for x in "ij")
    size = modules.groupBy(*own, F.col("module").alias("mi")).agg(F.count("*").alias("size")).filter("size > 1")
    inside = edges.join(dist, ["i", "j"]).join(mi, [*keys, "i"]).join(mj, [*own, "j"]).filter("mi = mj")
    per = inside.groupBy(*own, "mi").agg(F.sum("dist").alias("d")).join(size, [*own, "mi"])
    return per.groupBy(*own).agg(F.max(F.when(F.col("d") != 0, F.col("d") / F.col("size"))).alias("span"))


def mean_over_runs(edges: DataFrame, runs: DataFrame, dist: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Of the partitions of several runs (keys, run, node, module, q): means of modularity and modular span for each graph, and each node's mean participation with its module in the first run."""
    keys = list(keys)
    modules = runs.select(*keys, "run", "node", "module")
    q = runs.groupBy(*keys, "run").agg(F.first("q").alias("q")).groupBy(*keys).agg(F.avg("q").alias("modularity"))
    span = modular_span(edges, modules, dist, keys, ["run"]).groupBy(*keys).agg(F.avg("span").alias("span"))
    nodal = participation(edges, modules, keys, ["run"]).groupBy(*keys, "node").agg(F.avg("participation").alias("participation"))
    first = modules.filter("run = 0").select(*keys, "node", "module")
    return q.join(span, keys, "left"), nodal.join(first, [*keys, "node"])


def mask_network(conn: DataFrame, network: DataFrame, keys: Keys = (), inside: bool = True) -> DataFrame:
    """conn with weights outside the network's edges (keys, i, j) set to 0, or those inside."""
    marked = conn.join(network.select(*keys, "i", "j", F.lit(True).alias("_in")).distinct(), [*keys, "i", "j"], "left")
    keep = F.coalesce("_in", F.lit(False))
    return marked.withColumn("w", F.when(keep if inside else ~keep, F.col("w")).otherwise(0.0)).drop("_in")


def relabel(modules: DataFrame, keys: Keys) -> DataFrame:
    """Modules numbered by their first node; all of one node share the number after the last."""
    keys = list(keys)
    own = Window.partitionBy(*keys, "module")
    df = modules.withColumn("size", F.count("*").over(own)).withColumn("first", F.min("node").over(own))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.when(F.col("size") == 1, 1).otherwise(0), F.when(F.col("size") > 1, F.col("first"))))
    return df.select(*keys, "node", rank.alias("module"))


def partition_nmi(joint: DataFrame, x: str, y: str, n: str = "n", keys: Keys = ()) -> DataFrame:
    """2 I / (H1 + H2) of two partitions from the joint counts; 1 where both have one part."""
    keys = list(keys)
    total = F.sum(n).over(Window.partitionBy(*keys))
    px, py = F.sum(n).over(Window.partitionBy(*keys, x)) / total, F.sum(n).over(Window.partitionBy(*keys, y)) / total
    p = joint.select(*keys, (F.col(n) / total).alias("p"), px.alias("px"), py.alias("py"))
    agg = p.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("i"), F.sum(-F.col("p") * F.log("px")).alias("hx"), F.sum(-F.col("p") * F.log("py")).alias("hy"))
    return agg.select(*keys, F.when(F.col("hx") + F.col("hy") == 0, 1.0).otherwise(2 * F.col("i") / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0))).alias("nmi"))


def network_components(edges: DataFrame, keys: Keys) -> DataFrame:
    """Components of suprathreshold edges with their intensity, the sum of their weights; the largest is the network-based statistic."""

    def run(p, nodes, a):
        d, seen, out = distances(a), np.full(len(a), -1), []
        for v in range(len(a)):
            if seen[v] < 0:
                seen[np.isfinite(d[v])] = v
        for c in np.unique(seen):
            at = seen == c
            out.append((nodes[c], int(at.sum()), float(a[np.ix_(at, at)].sum() / 2)))
        return pd.DataFrame(out, columns=["component", "nodes", "intensity"])

    return _by_graph(edges, keys, nodes(edges, keys), run, f"component {dict(edges.dtypes)['i']}, nodes long, intensity double")
