"""URL filters: fixed host and path rules first, association rules mined by FP-growth for the rest."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
VERDICT = "verdict="
#: Frequent items of one row up to which FP-growth takes them all together.
WIDEST = 18


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, from the first :// up to / ? # or the end, A-Z lower-cased, and path, then up to ? # or the end. Both are empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rules(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A url's items: every suffix of its host and each of its labels, each part of its path and the first once more as such, whether the path ends in / or an extension, and the names in its query. Digits count as 0."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    single = F.transform(labels, lambda x: F.concat(F.lit("label:"), F.regexp_replace(x, r"\d+", "0")))
    parts = F.filter(F.split(F.regexp_replace(path, r"\d+", "0"), "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path:"), x))
    query = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), r"\d+", "0"), "&"), lambda x: x != "")
    names = F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    shape = F.array(F.concat(F.lit("first:"), F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), F.concat(F.lit("end:"), F.regexp_extract(path, r"(/|\.[A-Za-z]+)$", 1)))
    return F.array_distinct(F.concat(suffixes, single, segments, names, shape))


def grown(baskets: DataFrame, least: float, confidence: float, n: int) -> list[tuple[frozenset[str], str, float, float]]:
    """FP-growth's rules from items to a verdict over baskets (items, one of them the verdict): items, verdict, confidence, support as a share of n rows."""
    total = baskets.count()
    if not total:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith(VERDICT) & ~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
    return [(frozenset(r["antecedent"]), r["consequent"][0].removeprefix(VERDICT), r["confidence"], r["support"] * total / n) for r in rules.select("antecedent", "consequent", "confidence", "support").collect()]


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.6, longest: int = 3, widest: int = WIDEST) -> list[tuple[frozenset[str], str, float, float]]:
    """Rules (items, verdict, confidence, support) of at most `longest` items from rows of items and label, all from FP-growth.

    Frequent items are told by a count first, as in any FP-growth; of those that stand in the very same rows, which a sum
    of the rows' hashes tells, the smallest speaks for all, so that long urls with fixed parts make few sets. FP-growth
    then runs on Spark over all labelled rows, each with its frequent items and its verdict. Where a row has more than
    `widest` of them, sets could become too many: then items that always come with one verdict are mined one by one and
    the others in sets. That gives the same rules, since a rule goes if a part of it is as sure, and none is surer than
    an item that always comes with one verdict. Supports are shares of the rows, so mean items of a row / support bounds
    the items that reach the driver, whatever the row count.
    """
    n = labelled.count()
    if not n:
        return []
    flat = labelled.withColumn("row", F.xxhash64("items", "label", F.monotonically_increasing_id())).select("label", "row", F.explode("items").alias("item"))
    per = flat.groupBy("item", "label").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("rows"))
    per = per.groupBy("item").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("rows").alias("rows")).filter(F.col("n") >= support * n)
    speaks: dict = {}
    for r in sorted(per.collect(), key=lambda r: r["item"]):  # frequent items only
        speaks.setdefault((r["n"], r["rows"]), r)
    sure, unsure = [r["item"] for r in speaks.values() if r["most"] == r["n"]], [r["item"] for r in speaks.values() if r["most"] < r["n"]]
    own = lambda some: F.filter("items", lambda x: x.isin(some)) if some else F.array().cast("array<string>")
    verdict = F.array(F.concat(F.lit(VERDICT), F.col("label")))
    together = lambda some: labelled.select(F.concat(own(some), verdict).alias("items"))
    if (labelled.agg(F.max(F.size(own(sure + unsure)))).collect()[0][0] or 0) <= widest:
        got = grown(together(sure + unsure), support * n, confidence, n)
    else:
        alone = labelled.select("label", F.explode(own(sure)).alias("item")).select(F.concat(F.array("item"), verdict).alias("items"))
        got = grown(alone, support * n, confidence, n) + grown(together(unsure), support * n, confidence, n)
    best: dict = {}
    for r in sorted(got, key=lambda r: (len(r[0]), -r[2], -r[3], sorted(r[0]))):  # a rule stays if no part of it is as sure
        if len(r[0]) <= longest and (r[0], r[1]) not in best and not any(part < r[0] and v == r[1] and c >= r[2] for (part, v), (c, _) in best.items()):
            best[r[0], r[1]] = (r[2], r[3])
    return [(items, v, c, s) for (items, v), (c, s) in best.items()]


def judge(pages: DataFrame, support: float = 0.01, confidence: float = 0.6, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    The fixed rules label what they fit; association rules mined from these labels judge the rest, through an inverted
    index from item to rules of at most three items: the surest rule whose items are all there, then the one of most
    support, then of most items, then the first by name. Urls that no rule fits, null, empty and malformed ones too, get
    `default`. Equal rows are judged alike, and urls of any length by all their items. Other columns, whatever their
    names, don't matter; an empty table gives an empty result.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").alias("page_id"), url.alias("url"))
    host, path = url_parts(F.col("url"))
    df = fixed_rules(df.select("page_id", host.alias("host"), path.alias("path"), "url")).withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = df.filter("rule is not null").select("items", F.col("rule_verdict").alias("label"))
    rules = sorted(mine(labelled, support, confidence), key=lambda r: (-r[2], -r[3], -len(r[0]), sorted(r[0])))
    index = defaultdict(list)
    for k, r in enumerate(rules):
        for item in r[0]:
            index[item].append(k)
    sizes, verdicts = [len(r[0]) for r in rules], [r[1] for r in rules]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fixed, items in zip(b.column("rule_verdict").to_pylist(), b.column("items").to_pylist(), strict=True):
                if fixed is None:
                    met: dict[int, int] = defaultdict(int)
                    for item in items:
                        for k in index.get(item, ()):
                            met[k] += 1
                    fixed = verdicts[k] if (k := min((k for k, n in met.items() if n == sizes[k]), default=-1)) >= 0 else default
                out.append(fixed)
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, pa.string())], [*names, "verdict"])

    return df.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(match, "page_id long, host string, path string, rule string, verdict string")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
