"""Graph queries over `embeddings`: a correlation graph of the 64 positions for each label, its strongest 30 %."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import colour_index, r9, rescale
from latticework.operators import graph as G
from latticework.operators.reference import density_range, thresholds
from latticework.operators.similarity import subject_pairs_nmi
from latticework.session import table

KEYS = ["label"]
PARTS = 4


def conn(spark, d) -> DataFrame:
    return G.correlations(table(spark, d, "embeddings").select("label", "embedding"), "embedding", KEYS)


def edges(spark, d, density: float = 0.3) -> DataFrame:
    return G.cut(G.ranked(conn(spark, d), KEYS), density).select("label", "i", "j", "w")


def nodes(spark, d) -> DataFrame:
    """All positions of each label's vectors, linked or not."""
    e = table(spark, d, "embeddings").select("label", F.size("embedding").alias("n")).filter("n > 0").groupBy("label").agg(F.max("n").alias("n"))
    return e.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("node"))


def modules(n: DataFrame) -> DataFrame:
    """Each node is in module node mod 4."""
    return n.select("label", "node", (F.col("node") % PARTS + 1).alias("module"))


def positions(e: DataFrame) -> DataFrame:
    """Distances of positions on a line of length 1."""
    return e.select("i", "j").distinct().withColumn("dist", (F.col("j") - F.col("i")) / 63.0)


def out(df, keys, *values):
    return df.select(*keys, *[r9(F.col(v)).alias(v) for v in values])


def sparse(spark, d):
    return edges(spark, d, 0.1)


def sweep(spark, d):
    ranks = G.ranked(conn(spark, d), KEYS).select("label", "i", "j", "w", "rank", "n")
    return out(G.sweep(ranks, density_range(thresholds(spark))).groupBy("label", "t_idx").agg(F.count("*").alias("edges"), F.avg("w").alias("w")), ["label", "t_idx", "edges"], "w")


def modular(measure):
    def q(spark, d):
        return measure(edges(spark, d), modules(nodes(spark, d)))

    return q


def scaled(spark, d):
    e = edges(spark, d)
    lim = e.groupBy("label").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    s = e.join(lim, "label").withColumn("size", rescale(F.col("w"), F.col("lo"), F.col("hi")))
    return out(s.withColumn("colour", colour_index(r9(F.col("size")), 64)), ["label", "i", "j", "colour"], "size")


def arcs(spark, d):
    e = edges(spark, d)
    inside = e.filter(F.col("i") % PARTS == F.col("j") % PARTS)
    return inside.select("label", "i", "j", F.round(F.col("w") * 0.5 + 1, 12).alias("height"))


def mean_graph(spark, d):
    c = conn(spark, d).withColumn("grp", (F.col("label") % 2).cast("int")).groupBy("grp", "i", "j").agg(r9(F.avg("w")).alias("w"))
    return G.degree(G.cut(G.ranked(c, ["grp"]), 0.3), ["grp"], G.nodes(c, ["grp"]))


def nodal_z(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    g = G.degree(edges(spark, d), KEYS, nodes(spark, d))
    return out(g.withColumn("z", (F.col("degree") - F.avg("degree").over(w)) / F.nullif(F.stddev_samp("degree").over(w), F.lit(0.0))), ["label", "node"], "z")


def louvain(spark, d):
    g = G.louvain(edges(spark, d), KEYS, nodes(spark, d))
    return out(g.groupBy("label", "run").agg(F.max("module").alias("modules"), F.first("q").alias("q")), ["label", "run", "modules"], "q")


def run_means(spark, d):
    """Means over 50 runs: modularity, modular span, and each node's participation, with its module in the first run."""
    e = edges(spark, d)
    graph, nodal = G.mean_over_runs(e, G.louvain(e, KEYS, nodes(spark, d)), positions(e), KEYS)
    return out(nodal.join(graph, KEYS), ["label", "node", "module"], "participation", "modularity", "span")


def masked(inside: bool):
    """Weights inside, or outside, the network of the strongest 10 % of the pairs."""

    def q(spark, d):
        return G.mask_network(conn(spark, d), sparse(spark, d), KEYS, inside).select("label", "i", "j", "w")

    return q


def nmi(spark, d):
    joint = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").cast("double").alias("n"))
    return out(G.partition_nmi(joint, "lang", "source"), [], "nmi")


def subject_nmi(spark, d):
    """NMI of every pair of labels' partitions of the nodes, by degree modulo 3."""
    m = G.degree(edges(spark, d), KEYS, nodes(spark, d)).select("label", "node", (F.col("degree") % 3).alias("module"))
    return out(subject_pairs_nmi(m, subject="label"), ["s1", "s2"], "nmi")


QUERIES = {
    "corr_connectivity": conn,
    "threshold_proportional": edges,
    "density_sweep": sweep,
    "degree": lambda s, d: G.degree(edges(s, d), KEYS, nodes(s, d)),
    "node_strength": lambda s, d: out(G.strength(conn(s, d), KEYS), ["label", "node"], "strength"),
    "clustering_coef": lambda s, d: out(G.clustering(edges(s, d), KEYS, nodes(s, d)), ["label", "node", "degree"], "clustering"),
    "shortest_paths": lambda s, d: G.shortest_paths(sparse(s, d), KEYS, nodes(s, d)),
    "char_path_length": lambda s, d: out(G.path_length(G.shortest_paths(sparse(s, d), KEYS, nodes(s, d)), KEYS), KEYS, "path_length"),
    "global_efficiency": lambda s, d: out(G.efficiency(G.shortest_paths(sparse(s, d), KEYS, nodes(s, d)), KEYS, nodes(s, d)), KEYS, "efficiency"),
    "betweenness": lambda s, d: out(G.betweenness(sparse(s, d), KEYS, nodes(s, d)), ["label", "node"], "betweenness"),
    "participation_coef": modular(lambda e, m: out(G.participation(e, m, KEYS), ["label", "node"], "participation")),
    "modularity_q": modular(lambda e, m: out(G.modularity(e, m, KEYS), KEYS, "q")),
    "modular_span": modular(lambda e, m: out(G.modular_span(e, m, positions(e), KEYS), KEYS, "span")),
    "relabel_modules": modular(lambda e, m: G.relabel(m, KEYS)),
    "louvain": louvain,
    "louvain_means": run_means,
    "network_mask": masked(True),
    "network_complement": masked(False),
    "partition_nmi": nmi,
    "subject_partition_nmi": subject_nmi,
    "group_mean_graph": mean_graph,
    "zscore_nodes": nodal_z,
    "edge_scaling": scaled,
    "arc_list": arcs,
    "network_components": lambda s, d: out(G.network_components(edges(s, d, 0.01), KEYS), ["label", "component", "nodes"], "intensity"),
}

_V = "v AS (SELECT label, vec_id, CAST(unnest(range(0,len(embedding))) AS BIGINT) AS ch, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), conn AS (SELECT a.label, a.ch AS i, b.ch AS j, round(corr(a.x,b.x),9) AS w FROM v a JOIN v b ON a.vec_id=b.vec_id AND a.ch<b.ch GROUP BY ALL)"
_RK = _V + ", rk AS (SELECT label, i, j, abs(w) AS w, row_number() OVER (PARTITION BY label ORDER BY abs(w) DESC, i, j) AS r, count(*) OVER (PARTITION BY label) AS n FROM conn)"


def _e(density: float) -> str:
    return _RK + f", e AS (SELECT label, i, j, w FROM rk WHERE r<=round(n*{density}) AND w<>0), adj AS (SELECT label, i AS a, j AS b, w FROM e UNION ALL SELECT label, j, i, w FROM e), nd AS (SELECT DISTINCT label, ch AS node FROM v), deg AS (SELECT nd.label, node, count(b) AS degree FROM nd LEFT JOIN adj ON adj.label=nd.label AND a=node GROUP BY ALL)"


_E, _SPARSE = _e(0.3), _e(0.1)
_D = _SPARSE + ", RB(label,s,t,d) AS (SELECT DISTINCT label, a, a, 0 FROM adj UNION SELECT x.label, x.s, adj.b, x.d+1 FROM RB x JOIN adj ON x.label=adj.label AND x.t=adj.a WHERE x.d<10), dist AS (SELECT label, s, t, CAST(min(d) AS BIGINT) AS d FROM RB WHERE s<>t GROUP BY ALL)"
_MOD = _E + ", mo AS (SELECT label, node, node%4+1 AS module FROM deg)"

ORACLE = {
    "corr_connectivity": f"WITH {_V} SELECT * FROM conn",
    "threshold_proportional": f"WITH {_E} SELECT * FROM e",
    "density_sweep": f"WITH {_RK}, t AS (SELECT CAST(k AS INT) AS t_idx, (1000-25*k)/1000.0 AS density FROM (SELECT unnest(range(0,37)) AS k)) SELECT label, t_idx, count(*) AS edges, round(avg(w),9) AS w FROM rk JOIN t ON r<=round(n*CAST(density AS DOUBLE)) AND w<>0 WHERE density BETWEEN 0.1 AND 0.9 GROUP BY ALL",
    "degree": f"WITH {_E} SELECT * FROM deg",
    "node_strength": f"WITH {_V} SELECT label, node, round(sum(w)/count(*),9) AS strength FROM (SELECT label, i AS node, w FROM conn UNION ALL SELECT label, j, w FROM conn) GROUP BY ALL",
    "clustering_coef": f"WITH {_E}, tri AS (SELECT x.label, x.a AS node, count(*) AS t FROM adj x JOIN adj y ON x.label=y.label AND x.a=y.a AND x.b<y.b JOIN e ON e.label=x.label AND e.i=x.b AND e.j=y.b GROUP BY ALL) SELECT label, node, degree, round(CASE WHEN degree<2 THEN 0.0 ELSE 2.0*coalesce(t,0)/(degree*(degree-1)) END,9) AS clustering FROM deg LEFT JOIN tri USING (label, node)",
    "shortest_paths": f"WITH RECURSIVE {_D} SELECT * FROM dist",
    "char_path_length": f"WITH RECURSIVE {_D} SELECT label, round(avg(d),9) AS path_length FROM dist GROUP BY 1",
    "global_efficiency": f"WITH RECURSIVE {_D} SELECT label, round(coalesce(any_value(x),0)/(count(*)*(count(*)-1)),9) AS efficiency FROM nd LEFT JOIN (SELECT label AS l, sum(1.0/d) AS x FROM dist GROUP BY 1) ON l=label GROUP BY 1",
    "betweenness": f"WITH RECURSIVE {_D}, RP(label,s,t,d,c) AS (SELECT label, node, node, 0, CAST(1 AS DOUBLE) FROM nd UNION ALL SELECT r.label, r.s, dist.t, r.d+1, sum(r.c) FROM RP r JOIN adj ON r.label=adj.label AND r.t=adj.a JOIN dist ON dist.label=r.label AND dist.s=r.s AND dist.t=adj.b AND dist.d=r.d+1 GROUP BY r.label, r.s, dist.t, r.d), b AS (SELECT x.label, x.t AS node, sum(x.c*y.c/z.c) AS v FROM RP x JOIN RP y ON x.label=y.label AND x.t=y.s JOIN RP z ON z.label=x.label AND z.s=x.s AND z.t=y.t AND z.d=x.d+y.d WHERE x.d>0 AND y.d>0 GROUP BY ALL) SELECT nd.label, nd.node, round(coalesce(v,0.0),9) AS betweenness FROM nd LEFT JOIN b ON b.label=nd.label AND b.node=nd.node",
    "network_mask": f"WITH {_SPARSE} SELECT conn.label, conn.i, conn.j, CASE WHEN e.i IS NULL THEN 0.0 ELSE conn.w END AS w FROM conn LEFT JOIN e ON e.label=conn.label AND e.i=conn.i AND e.j=conn.j",
    "network_complement": f"WITH {_SPARSE} SELECT conn.label, conn.i, conn.j, CASE WHEN e.i IS NULL THEN conn.w ELSE 0.0 END AS w FROM conn LEFT JOIN e ON e.label=conn.label AND e.i=conn.i AND e.j=conn.j",
    "network_components": f"WITH RECURSIVE {_e(0.01)}, RC(label,s,t) AS (SELECT label, a, a FROM adj UNION SELECT r.label, r.s, adj.b FROM RC r JOIN adj ON r.label=adj.label AND r.t=adj.a), c AS (SELECT label, s AS node, min(t) AS root FROM RC GROUP BY ALL), z AS (SELECT label, root, count(*) AS nodes FROM c GROUP BY ALL), w AS (SELECT e.label, root, sum(w) AS intensity FROM e JOIN c ON c.label=e.label AND c.node=e.i GROUP BY ALL) SELECT z.label, z.root AS component, nodes, round(intensity,9) AS intensity FROM z JOIN w ON w.label=z.label AND w.root=z.root",
    "participation_coef": f"WITH {_MOD}, k AS (SELECT label, a AS node, module, count(*) AS k FROM adj JOIN (SELECT label, node AS b, module FROM mo) USING (label, b) GROUP BY ALL) SELECT nd.label, nd.node, round(coalesce(1-sum(k*k)/CAST(sum(k)*sum(k) AS DOUBLE),0.0),9) AS participation FROM nd LEFT JOIN k ON k.label=nd.label AND k.node=nd.node GROUP BY ALL",
    "modularity_q": f"WITH {_MOD}, k AS (SELECT label, a%4 AS m, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CASE WHEN a%4=b%4 THEN 1 ELSE 0 END) AS DOUBLE) AS inside FROM adj GROUP BY ALL), p AS (SELECT label, inside/sum(k) OVER (PARTITION BY label)-(k/sum(k) OVER (PARTITION BY label))**2 AS part FROM k) SELECT label, round(sum(part),9) AS q FROM p GROUP BY 1",
    "modular_span": f"WITH {_MOD}, z AS (SELECT label, module AS m, count(*) AS size FROM mo GROUP BY ALL HAVING count(*)>1), p AS (SELECT label, i%4+1 AS m, sum((j-i)/63.0) AS d FROM e WHERE i%4=j%4 GROUP BY ALL) SELECT label, round(max(CASE WHEN d<>0 THEN d/size END),9) AS span FROM p JOIN z USING (label, m) GROUP BY 1",
    "relabel_modules": f"WITH {_MOD}, y AS (SELECT *, count(*) OVER (PARTITION BY label, module) AS size, min(node) OVER (PARTITION BY label, module) AS first FROM mo) SELECT label, node, CAST(dense_rank() OVER (PARTITION BY label ORDER BY CASE WHEN size=1 THEN 1 ELSE 0 END, CASE WHEN size>1 THEN first END) AS INT) AS module FROM y",
    "partition_nmi": "WITH j AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL), p AS (SELECT n/sum(n) OVER () AS p, sum(n) OVER (PARTITION BY lang)/sum(n) OVER () AS px, sum(n) OVER (PARTITION BY source)/sum(n) OVER () AS py FROM j) SELECT round(2*sum(p*ln(p/(px*py)))/(sum(-p*ln(px))+sum(-p*ln(py))),9) AS nmi FROM p",
    "subject_partition_nmi": f"WITH {_E}, m AS (SELECT label, node, degree%3 AS m FROM deg), j AS (SELECT a.label AS s1, b.label AS s2, a.m AS m1, b.m AS m2, CAST(count(*) AS DOUBLE) AS n FROM m a JOIN m b ON a.node=b.node AND a.label<b.label GROUP BY ALL), p AS (SELECT s1, s2, n/sum(n) OVER g AS p, sum(n) OVER (PARTITION BY s1,s2,m1)/sum(n) OVER g AS px, sum(n) OVER (PARTITION BY s1,s2,m2)/sum(n) OVER g AS py FROM j WINDOW g AS (PARTITION BY s1, s2)) SELECT s1, s2, round(2*sum(p*ln(p/(px*py)))/(sum(-p*ln(px))+sum(-p*ln(py))),9) AS nmi FROM p GROUP BY ALL",
    "group_mean_graph": f"WITH {_V}, c AS (SELECT CAST(label%2 AS INT) AS grp, i, j, round(avg(w),9) AS w FROM conn GROUP BY ALL), rk AS (SELECT grp, i, j, abs(w) AS w, row_number() OVER (PARTITION BY grp ORDER BY abs(w) DESC, i, j) AS r, count(*) OVER (PARTITION BY grp) AS n FROM c), e AS (SELECT * FROM rk WHERE r<=round(n*0.3) AND w<>0), dd AS (SELECT grp, node, count(*) AS k FROM (SELECT grp, i AS node FROM e UNION ALL SELECT grp, j FROM e) GROUP BY ALL) SELECT n.grp, n.node, CAST(coalesce(k,0) AS BIGINT) AS degree FROM (SELECT DISTINCT CAST(label%2 AS INT) AS grp, ch AS node FROM v) n LEFT JOIN dd ON dd.grp=n.grp AND dd.node=n.node",
    "zscore_nodes": f"WITH {_E} SELECT label, node, round((degree-avg(degree) OVER (PARTITION BY label))/nullif(stddev_samp(degree) OVER (PARTITION BY label),0),9) AS z FROM deg",
    "edge_scaling": f"WITH {_E}, x AS (SELECT label, i, j, greatest((w-min(w) OVER (PARTITION BY label))/(max(w) OVER (PARTITION BY label)-min(w) OVER (PARTITION BY label)),0.0) AS size FROM e) SELECT label, i, j, CAST(least(greatest(round(round(size,9)*64),1),64) AS INT) AS colour, round(size,9) AS size FROM x",
    "arc_list": f"WITH {_E} SELECT label, i, j, round(w*0.5+1,12) AS height FROM e WHERE i%4=j%4",
}
