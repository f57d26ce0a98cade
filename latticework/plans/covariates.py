"""Covariate, selection and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.scalar import r9
from latticework.operators import geometry as M
from latticework.session import table


def diagnosis(df: DataFrame, code: str, *signs: str) -> DataFrame:
    """Code 6 where the code is 0 and any sign is 1."""
    sign = F.lit(False)
    for s in signs:
        sign = sign | (F.coalesce(F.col(s), F.lit(0)) == 1)
    return df.withColumn("diagnosis", F.when((F.col(code) == 0) & sign, 6).otherwise(F.col(code)))


def regroup(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes from 0 in the order of the distinct values, which are few and broadcast."""
    v = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(F.broadcast(v), column)


def in_group(df: DataFrame, groups: DataFrame, name: str, column: str, negate: bool = False) -> DataFrame:
    """Rows whose channel is in the named list, or isn't. Lists hold a montage's channels and broadcast."""
    g = groups.filter(F.col("grp") == name).select(F.col("channel").alias(column))
    return df.join(F.broadcast(g), column, "left_anti" if negate else "left_semi")


def auto_group(name: str, channels: int) -> str:
    """The list for all channels of a net goes by their number."""
    return f"allchan_{channels}" if name == "allchan" else name


def points(spark, d) -> DataFrame:
    """Channels at the first three components of the vectors."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("channel"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


def montages(spark, d) -> DataFrame:
    """A montage for each label: its vectors' positions, placed by their mean, deviation and largest value."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("channel", "v"))
    v = F.col("v").cast("double")
    return e.groupBy("label", "channel").agg(r9(F.avg(v)).alias("x"), r9(F.stddev_samp(v)).alias("y"), F.max(v).alias("z"))


def segments(spark) -> DataFrame:
    return spark.createDataFrame([("MACHINERY", "g"), ("BUILDING", "g")], "channel string, grp string")


def orders_diagnosis(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 6).cast("int").alias("crs"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("tennis"), (F.col("o_orderstatus") == "F").cast("int").alias("pet"))
    return diagnosis(o, "crs", "tennis", "pet").select("o_orderkey", "diagnosis")


def balance(spark, d, negate):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return in_group(c, segments(spark), "g", "c_mktsegment", negate).groupBy("c_mktsegment").agg(F.count("*").alias("n"), r9(F.avg("c_acctbal")).alias("mean"))


def distance(spark, d):
    return M.channel_distance(montages(spark, d), ["label"]).select("label", "i", "j", r9(F.col("dist")).alias("dist"))


def spline(spark, d):
    return M.spline_kernel(M.channel_distance(montages(spark, d), ["label"])).select("label", "i", "j", r9(F.col("g")).alias("g"))


def sphere(spark, d):
    return M.on_unit_sphere(points(spark, d)).select("channel", *[r9(F.col(c)).alias(c) for c in "xyz"])


def arcs(spark, d):
    p = points(spark, d)
    a = p.select("channel", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = p.select((F.col("channel") - 1).alias("channel"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    return M.arc_points(a.join(b, "channel"), samples=100).select("channel", "k", *[F.round(F.col(f"p{c}") + 1e-8, 6).alias(c) for c in "xyz"])  # wide circles lose digits


def reordered(spark, d):
    """Last position of each label when vectors are put in order of label."""
    e = table(spark, d, "embeddings").select("label", "vec_id")
    per = e.groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", F.sum("n").over(Window.orderBy("label")).alias("last"))


QUERIES = {
    "derived_diagnosis": orders_diagnosis,
    "regroup_codes": lambda s, d: regroup(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code"),
    "semi_channel_group": lambda s, d: balance(s, d, False),
    "anti_channels": lambda s, d: balance(s, d, True),
    "interchannel_distance": distance,
    "spline_kernel": spline,
    "unit_sphere": sphere,
    "arc_points": arcs,
    "group_boundaries": reordered,
    "colour_limits": lambda s, d: M.colour_limits(table(s, d, "events"), "value", ["event_type"]).select("event_type", r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi")),
}

_X = "c AS (SELECT vec_id AS channel, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_dot = lambda a, b: "+".join(f"{a}{c}*{b}{c}" for c in "xyz")
_three = lambda form: ", ".join(form.format(c=c) for c in "xyz")
_ARC = (
    f"WITH {_X}, p AS (SELECT a.channel, {_three('a.{c} AS p{c}')}, {_three('b.{c} AS q{c}')} FROM c a JOIN c b ON b.channel=a.channel+1)"
    f", m AS (SELECT *, {_three('(p{c}+q{c})/2*1.3-p{c} AS u{c}')}, {_three('q{c}-p{c} AS v{c}')} FROM p)"
    f", n AS (SELECT *, {_dot('u', 'u')} AS uu, {_dot('v', 'v')} AS vv, {_dot('u', 'v')} AS uv FROM m)"
    f", s AS (SELECT *, nullif(2*(uu*vv-uv*uv),0) AS den FROM n)"
    f", o AS (SELECT *, {_three('p{c}+vv*(uu-uv)/den*u{c}+uu*(vv-uv)/den*v{c} AS o{c}')} FROM s)"
    f", a AS (SELECT *, {_three('p{c}-o{c} AS a{c}')}, {_three('p{c}+u{c}-o{c} AS m{c}')}, {_three('q{c}-o{c} AS f{c}')} FROM o)"
    f", w AS (SELECT *, {_dot('a', 'a')} AS rr, {_three(f'm{{c}}-a{{c}}*({_dot("a", "m")})/({_dot("a", "a")}) AS w{{c}}')} FROM a)"
    f", e AS (SELECT *, {_three(f'w{{c}}*sqrt(rr)/nullif(sqrt({_dot("w", "w")}),0) AS e{{c}}')} FROM w)"
    f", g AS (SELECT *, atan2({_dot('f', 'e')}, {_dot('f', 'a')}) AS h FROM e)"
    f", k AS (SELECT *, CASE WHEN h<0 THEN h+2*pi() ELSE h END AS angle, CAST(unnest(range(0,100)) AS INT) AS k FROM g)"
    f" SELECT channel, k, {_three('round(o{c}+a{c}*cos(angle*k/99)+e{c}*sin(angle*k/99)+1e-8,6) AS {c}')} FROM k"
)
_MO = "u AS (SELECT label, CAST(unnest(range(0,len(embedding))) AS INT) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, channel, round(avg(v),9) AS x, round(stddev_samp(v),9) AS y, max(v) AS z FROM u GROUP BY ALL), d AS (SELECT a.label, a.channel AS i, b.channel AS j, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS dist FROM c a JOIN c b ON a.label=b.label AND a.channel<b.channel)"
_P = "1-dist AS p1, (3*(1-dist)**2-1)/2 AS p2, (5*(1-dist)**3-3*(1-dist))/2 AS p3, (35*(1-dist)**4-30*(1-dist)**2+3)/8 AS p4, (63*(1-dist)**5-70*(1-dist)**3+15*(1-dist))/8 AS p5, (231*(1-dist)**6-315*(1-dist)**4+105*(1-dist)**2-5)/16 AS p6, (429*(1-dist)**7-693*(1-dist)**5+315*(1-dist)**3-35*(1-dist))/16 AS p7"
_G = "+".join(f"{2 * n + 1}.0/{n**4 * (n + 1) ** 4}*p{n}" for n in range(1, 8))

ORACLE = {
    "derived_diagnosis": "SELECT o_orderkey, CAST(CASE WHEN o_custkey%6=0 AND (o_orderpriority='1-URGENT' OR o_orderstatus='F') THEN 6 ELSE o_custkey%6 END AS INT) AS diagnosis FROM orders",
    "regroup_codes": "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority)-1 AS INT) AS code FROM orders",
    "semi_channel_group": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal),9) AS mean FROM customer WHERE c_mktsegment IN ('MACHINERY','BUILDING') GROUP BY 1",
    "anti_channels": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal),9) AS mean FROM customer WHERE c_mktsegment NOT IN ('MACHINERY','BUILDING') GROUP BY 1",
    "interchannel_distance": f"WITH {_MO} SELECT label, i, j, round(dist,9) AS dist FROM d",
    "spline_kernel": f"WITH {_MO}, p AS (SELECT label, i, j, {_P} FROM d) SELECT label, i, j, round(({_G})/(4*pi()),9) AS g FROM p",
    "unit_sphere": f"WITH {_X}, r AS (SELECT channel, x, y, z-30 AS z, sqrt(x*x+y*y+(z-30)**2) AS r FROM c) SELECT channel, round(x/r,9) AS x, round(y/r,9) AS y, round(z/r,9) AS z FROM r",
    "arc_points": _ARC,
    "group_boundaries": "SELECT label, CAST(sum(count(*)) OVER (ORDER BY label) AS BIGINT) AS last FROM embeddings GROUP BY label",
    "colour_limits": "SELECT event_type, round(min(value)-(max(value)-min(value))*0.02,9) AS lo, round(max(value)+(max(value)-min(value))*0.02,9) AS hi FROM events GROUP BY 1",
}
