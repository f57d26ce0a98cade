"""Cohort queries: group contrasts over `embeddings` positions and `lineitem`, trends, discovery rates, permutations, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.scalar import chi2_one_df, normal_two_sided, r9
from latticework.operators import classify as C
from latticework.operators import stats as T
from latticework.operators.ranks import pair_ranks
from latticework.operators.selection import median
from latticework.session import table


def scores(spark, d) -> DataFrame:
    """feature (position), grp (label), score of all embeddings."""
    e = table(spark, d, "embeddings").filter("label is not null")
    return e.select("vec_id", F.col("label").alias("grp"), F.posexplode("embedding").alias("feature", "x")).select("vec_id", "grp", "feature", F.col("x").cast("double").alias("score"))


def lines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_discount")
    return li.select(F.col("l_linestatus").alias("grp"), F.explode(F.array(F.struct(F.lit("quantity").alias("feature"), F.col("l_quantity").alias("score")), F.struct(F.lit("discount").alias("feature"), F.col("l_discount").alias("score")))).alias("f")).select("grp", "f.*")


def counts_of(df):
    return pair_ranks(df, ["feature"])


def out(df, keys, *values):
    return df.select(*keys, *[r9(F.col(v)).alias(v) for v in values])


PAIR = ["feature", "g0", "g1"]


def auc(spark, d):
    return out(T.rank_statistics(counts_of(scores(spark, d)), ["feature"]), PAIR, "auc")


def ranksum(spark, d):
    return out(T.rank_statistics(counts_of(lines(spark, d)), ["feature"]), PAIR, "z")


def mann_whitney(spark, d):
    return out(T.rank_statistics(counts_of(lines(spark, d)), ["feature"]), PAIR, "n0", "n1", "u_min")


def threshold(spark, d):
    return out(T.youden(counts_of(scores(spark, d)), ["feature"]), PAIR, "threshold", "j")


def confusion(spark, d):
    return out(T.contingency(T.youden(counts_of(scores(spark, d)), ["feature"])), PAIR, "tn", "fp", "fn", "tp", "chi2", "accuracy")


def chi2(spark, d):
    return out(T.contingency(T.youden(counts_of(lines(spark, d)), ["feature"])).withColumn("p", chi2_one_df("chi2")), PAIR, "chi2", "p")


def ranksum_p(spark, d):
    return out(T.rank_statistics(counts_of(scores(spark, d)), ["feature"]).withColumn("p", F.coalesce("exact_p", normal_two_sided("z"))), PAIR, "z", "p")


def trend(spark, d):
    return out(T.jonckheere(T.value_counts(scores(spark, d).filter("grp < 5"), ["feature"]), ["feature"]), ["feature"], "jt", "z")


def tests(spark, d) -> DataFrame:
    """The rank-sum p and the AUC of each position and pair."""
    z = T.rank_statistics(counts_of(scores(spark, d)), ["feature"])
    return z.select(*PAIR, r9(F.coalesce("exact_p", normal_two_sided("z"))).alias("p"), r9(F.col("auc")).alias("auc"))


def tiers(spark, d):
    return T.tiers(T.discovery_threshold(tests(spark, d), "p"), "p").select(*PAIR, "p", "tier")


def best(spark, d):
    t = T.discovery_threshold(tests(spark, d), "p").withColumn("tie", F.col("feature") * 100 + F.col("g0") * 10 + F.col("g1"))
    return T.tiers(T.top(t, "auc", 10, "tie"), "p").select(*PAIR, "rank", "auc", "tier")


def permutations(spark, d):
    """Two conditions that take in every row: even and odd labels."""
    e = table(spark, d, "embeddings").filter("label is not null").select(F.col("vec_id").alias("unit"), F.pmod("label", F.lit(2)).cast("int").alias("grp"), F.posexplode("embedding").alias("feature", "x"))
    s = e.select("unit", "grp", "feature", F.col("x").cast("double").alias("score"))
    return out(T.max_statistic(T.permuted_differences(s, "score", ["feature"]), ["feature"]), ["feature"], "diff", "p")


def medians(spark, d):
    return out(T.median_of_medians(scores(spark, d).select("vec_id", "feature", "grp", "score"), "score", ["vec_id"], ["grp"]), ["grp"], "median")


def pooled(spark, d):
    s = scores(spark, d)
    means = s.groupBy("grp").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return out(median(s, "score", ["grp"]).join(means, "grp"), ["grp"], "median", "mean", "sd")


def bayes(spark, d):
    ev = table(spark, d, "events").groupBy(F.dayofyear("ts").alias("day"), F.col("event_type").alias("cls")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    p = ev.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("day"))).withColumn("k", F.col("day") % 7).withColumn("week", F.floor(F.col("day") / 7).cast("int"))
    return out(C.bayes(p.select("week", "day", "cls", "p"), ["week"], "day"), ["week", "day", "cls"], "posterior")


def mean_bayes(spark, d):
    return out(C.mean_posterior(bayes(spark, d), ["week"]), ["week", "cls"], "prob")


def votes(spark, d):
    lab = table(spark, d, "labels").select("doc_id", (F.col("quality") * 2 - 1).alias("s1"), F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("toxic") * 2 - 1).alias("s2"))
    return C.decode_votes(lab).select("doc_id", "cls")


def vote_accuracy(spark, d):
    """Two classifiers, quality and toxic, vote for the number of labels that are 1; by the id's remainder of 3."""
    v = votes(spark, d).join(table(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("true")), "doc_id")
    return out(C.decoding_accuracy(v.withColumn("fold", F.pmod("doc_id", F.lit(3))), ["fold"]), ["fold"], "accuracy")


def evidence(spark, d):
    """P(quality | toxic) of three ensemble members, the id's remainders of 3."""
    cm = table(spark, d, "labels").withColumn("member", F.pmod("doc_id", F.lit(3))).groupBy("member", "quality", "toxic").agg(F.count("*").alias("n"))
    return out(C.class_given_prediction(cm, ["member"], "quality", "toxic"), ["member", "quality", "toxic"], "p")


def segment_votes(spark, d):
    """The share of each customer segment's balances above 4500, as a posterior."""
    p = table(spark, d, "customer").groupBy("c_mktsegment").agg(r9(F.avg(F.when(F.col("c_acctbal") > 4500, 1.0).otherwise(0.0))).alias("p"))
    return C.posterior_vote(p, 0.5).select("c_mktsegment", "p", "vote")


QUERIES = {
    "ecc_accuracy": vote_accuracy,
    "class_given_prediction": evidence,
    "posterior_vote": segment_votes,
    "auc_folded": auc,
    "youden_threshold": threshold,
    "confusion_at_threshold": confusion,
    "chi2_2x2": chi2,
    "ranksum_z": ranksum,
    "ranksum_p": ranksum_p,
    "mann_whitney_u": mann_whitney,
    "jonckheere": trend,
    "fdr_threshold": lambda s, d: T.discovery_threshold(tests(s, d), "p").select(*PAIR, "p", "fdr"),
    "significance_tiers": tiers,
    "top_features": best,
    "permutation_maxstat": permutations,
    "group_mean_sem": lambda s, d: out(T.mean_sem(scores(s, d), "score", ["grp", "feature"]), ["grp", "feature"], "mean", "sem"),
    "median_of_medians": medians,
    "pooled_median": pooled,
    "sequential_bayes": bayes,
    "class_probability": mean_bayes,
    "ecc_decode": votes,
    "confusion_pct": lambda s, d: out(C.confusion_percent(table(s, d, "labels"), "quality", "toxic"), ["quality", "toxic", "n"], "pct"),
}

_SC = "sc AS (SELECT vec_id, label AS grp, CAST(unnest(range(0,len(embedding))) AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings WHERE {w})"
_LI = "sc AS (SELECT l_linestatus AS grp, 'quantity' AS feature, l_quantity AS score FROM lineitem UNION ALL SELECT l_linestatus, 'discount', l_discount FROM lineitem)"
_PC = ", g AS (SELECT DISTINCT grp FROM sc), pairs AS (SELECT a.grp AS g0, b.grp AS g1 FROM g a JOIN g b ON a.grp<b.grp), pc AS (SELECT feature, g0, g1, score, CAST(count(*) FILTER (grp=g0) AS DOUBLE) AS n0, CAST(count(*) FILTER (grp=g1) AS DOUBLE) AS n1 FROM sc JOIN pairs ON grp=g0 OR grp=g1 GROUP BY ALL)"
_ST = _PC + ", ru AS (SELECT *, n1*(coalesce(sum(n0) OVER (PARTITION BY feature,g0,g1 ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)+n0/2) AS u FROM pc), st0 AS (SELECT feature, g0, g1, sum(n0) AS n0, sum(n1) AS n1, sum(u) AS u, sum((n0+n1)**3-(n0+n1)) AS ties FROM ru GROUP BY ALL), st AS (SELECT *, greatest(u/(n0*n1),1-u/(n0*n1)) AS auc, least(u,n0*n1-u) AS u_min, (u-n0*n1/2)/sqrt(n0*n1/12*(n0+n1+1-ties/((n0+n1)*(n0+n1-1)))) AS z FROM st0)"
_YO = _PC + ", yo AS (SELECT *, sum(n0) OVER t AS fp_at, sum(n1) OVER t AS tp_at, sum(n0) OVER a AS neg, sum(n1) OVER a AS pos FROM pc WINDOW t AS (PARTITION BY feature,g0,g1 ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature,g0,g1)), yb AS (SELECT * FROM (SELECT *, round(abs(tp_at/pos-fp_at/neg),9) AS j, row_number() OVER (PARTITION BY feature,g0,g1 ORDER BY round(abs(tp_at/pos-fp_at/neg),9) DESC, score DESC) AS r FROM yo) WHERE r=1), cm AS (SELECT feature, g0, g1, neg-(fp_at-n0) AS tn, fp_at-n0 AS fp, pos-(tp_at-n1) AS fn, tp_at-n1 AS tp FROM yb)"
_EM = "WITH " + _SC.format(w="label IS NOT NULL")
#: 1 less the error function's power series.
_ERFC = "(1-list_sum(list_transform(range(0,200), lambda n: CASE WHEN {x}=0 THEN 0.0 ELSE exp(0-({x})**2+(2*n+1)*ln({x})-lgamma(n+1.5)) END)))"
_TE = _EM + _ST + ", te AS (SELECT feature, g0, g1, round(" + _ERFC.format(x="abs(z)/sqrt(2)") + ",9) AS p, round(auc,9) AS auc FROM st), tr AS (SELECT *, rank() OVER (ORDER BY p)+count(*) OVER (PARTITION BY p)-1 AS i, count(*) OVER () AS m FROM te), fd AS (SELECT feature, g0, g1, p, auc, coalesce(max(CASE WHEN p<=0.05*i/m THEN p END) OVER (),0.0) AS fdr FROM tr)"
_TIER = "CASE WHEN p<=fdr AND fdr>0 THEN 2 WHEN p<0.05 THEN 1 END"
_BA = "WITH ev AS (SELECT CAST(dayofyear(ts) AS INT) AS day, event_type AS cls, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT CAST(floor(day/7) AS INT) AS week, day, cls, n/CAST(sum(n) OVER (PARTITION BY day) AS DOUBLE) AS p FROM ev), l AS (SELECT *, sum(ln(p)) OVER (PARTITION BY week, cls ORDER BY day ROWS UNBOUNDED PRECEDING) AS l FROM p), e AS (SELECT *, exp(l-max(l) OVER (PARTITION BY week, day)) AS e FROM l), b AS (SELECT week, day, cls, e/sum(e) OVER (PARTITION BY week, day) AS posterior FROM e)"

ORACLE = {
    "ecc_accuracy": "WITH c AS (SELECT doc_id%3 AS fold, quality+toxic AS t, CASE WHEN s1=-1 AND s2=-1 THEN 1 WHEN s1=-1 THEN 0 WHEN s2=1 AND s1=0 THEN 2 ELSE 1 END AS cls FROM (SELECT doc_id, quality, toxic, quality*2-1 AS s1, CASE WHEN doc_id%5=0 THEN 0 ELSE toxic*2-1 END AS s2 FROM labels)) SELECT fold, round(100.0*avg(CASE WHEN t=cls THEN 1.0 ELSE 0.0 END),9) AS accuracy FROM c GROUP BY 1",
    "class_given_prediction": "WITH c AS (SELECT doc_id%3 AS member, quality, toxic, count(*) AS n FROM labels GROUP BY ALL), r AS (SELECT *, round(100.0*n/CAST(sum(n) OVER (PARTITION BY member, quality) AS DOUBLE))+2.220446049250313e-16 AS r FROM c) SELECT member, quality, toxic, round(r/sum(r) OVER (PARTITION BY member, toxic),9) AS p FROM r",
    "posterior_vote": "WITH p AS (SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal>4500 THEN 1.0 ELSE 0.0 END),9) AS p FROM customer GROUP BY 1) SELECT c_mktsegment, p, CAST(CASE WHEN p>=0.5 THEN 1 ELSE -1 END AS INT) AS vote FROM p",
    "auc_folded": f"{_EM}{_ST} SELECT feature, g0, g1, round(auc,9) AS auc FROM st",
    "youden_threshold": f"{_EM}{_YO} SELECT feature, g0, g1, round(score,9) AS threshold, j FROM yb",
    "confusion_at_threshold": f"{_EM}{_YO} SELECT feature, g0, g1, tn, fp, fn, tp, round((tn+fp+fn+tp)*(tn*tp-fp*fn)**2/nullif((tn+fp)*(fn+tp)*(tn+fn)*(fp+tp),0),9) AS chi2, round(100*(tn+tp)/(tn+fp+fn+tp),9) AS accuracy FROM cm",
    "ranksum_p": f"{_EM}{_ST} SELECT feature, g0, g1, round(z,9) AS z, round({_ERFC.format(x='abs(z)/sqrt(2)')},9) AS p FROM st",
    "chi2_2x2": f"WITH {_LI}{_YO}, ch AS (SELECT feature, g0, g1, (tn+fp+fn+tp)*(tn*tp-fp*fn)**2/nullif((tn+fp)*(fn+tp)*(tn+fn)*(fp+tp),0) AS c FROM cm) SELECT feature, g0, g1, round(c,9) AS chi2, round({_ERFC.format(x='sqrt(c/2)')},9) AS p FROM ch",
    "ranksum_z": f"WITH {_LI}{_ST} SELECT feature, g0, g1, round(z,9) AS z FROM st",
    "mann_whitney_u": f"WITH {_LI}{_ST} SELECT feature, g0, g1, n0, n1, u_min FROM st",
    "jonckheere": "WITH " + _SC.format(w="label<5") + _ST + ", jt AS (SELECT feature, sum(u) AS jt FROM st GROUP BY 1), sz AS (SELECT feature, sum(n) AS n, sum(n*n) AS n2, sum(n*n*(2*n+3)) AS n3 FROM (SELECT feature, grp, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY ALL) GROUP BY 1) SELECT feature, round(jt,9) AS jt, round((jt-(n*n-n2)/4)/sqrt((n*n*(2*n+3)-n3)/72),9) AS z FROM jt JOIN sz USING (feature)",
    "fdr_threshold": f"{_TE} SELECT feature, g0, g1, p, fdr FROM fd",
    "significance_tiers": f"{_TE} SELECT * FROM (SELECT feature, g0, g1, p, {_TIER} AS tier FROM fd) WHERE tier IS NOT NULL",
    "top_features": f"{_TE} SELECT * FROM (SELECT feature, g0, g1, CAST(row_number() OVER (ORDER BY auc DESC, feature*100+g0*10+g1) AS INT) AS rank, auc, {_TIER} AS tier FROM fd) WHERE rank<=10 AND tier IS NOT NULL",
    "group_mean_sem": f"{_EM} SELECT grp, feature, round(avg(score),9) AS mean, round(stddev_samp(score)/sqrt(count(*)),9) AS sem FROM sc GROUP BY ALL",
    "median_of_medians": f"{_EM}, m AS (SELECT grp, vec_id, median(score) AS m FROM sc GROUP BY ALL) SELECT grp, round(median(m),9) AS median FROM m GROUP BY 1",
    "pooled_median": f"{_EM} SELECT grp, round(median(score),9) AS median, round(avg(score),9) AS mean, round(stddev_samp(score),9) AS sd FROM sc GROUP BY 1",
    "sequential_bayes": f"{_BA} SELECT week, day, cls, round(posterior,9) AS posterior FROM b",
    "class_probability": f"{_BA} SELECT week, cls, round(avg(round(posterior,9)),9) AS prob FROM b GROUP BY ALL",
    "ecc_decode": "SELECT doc_id, CASE WHEN s1=-1 AND s2=-1 THEN 1 WHEN s1=-1 THEN 0 WHEN s2=1 AND s1=0 THEN 2 ELSE 1 END AS cls FROM (SELECT doc_id, quality*2-1 AS s1, CASE WHEN doc_id%5=0 THEN 0 ELSE toxic*2-1 END AS s2 FROM labels)",
    "confusion_pct": "WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic) SELECT quality, toxic, n, round(100.0*n/CAST(sum(n) OVER (PARTITION BY quality) AS DOUBLE),9) AS pct FROM c",
}
