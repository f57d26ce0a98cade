"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """src, source_size, target per source, from a table of src and size.

    Sources in code point order, null last, get the weights in turn. A source whose share would exceed cap times its
    size stops there, and the rest is shared again: sources stop in ascending order of capacity for each unit of
    weight, so the k that stop are the first k for which the next one's capacity holds its share.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1  # a row per source
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))
    per = per.withColumn("limit", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("fits", F.col("ratio") >= F.col("level"))
    at = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(every)
    return per.select("src", "source_size", "n_docs", F.least("limit", F.col("weight") * F.coalesce(at, F.lit(0.0))).alias("target"))


def _settle(block: Column, seed: int) -> Column:
    """One block's chain of pivots: struct(done, open). Each item has key, size and p; done items have p 0 or 1.

    The open item and the next share the words size times p between them: either the open one gives until it or the
    other is integral, or it takes, with the chances that leave both expectations as they were.
    """
    item = "struct<doc_id:bigint,src:string,size:bigint,source_size:bigint,target:double,whole:bigint,p:double,h:bigint>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))

    def fixed(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"], x["src"], x["size"], x["source_size"], x["target"], x["whole"], p.alias("p"), x["h"])

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        mass = lambda x, p: x["size"] * p
        give = F.least(mass(a, a["p"]), mass(b, 1 - b["p"]))  # from a to b
        take = F.least(mass(b, b["p"]), mass(a, 1 - a["p"]))
        u = F.pmod(F.xxhash64(a["h"], b["h"], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        gives = u * (give + take) < take
        moved = F.struct(F.when(gives, -give).otherwise(take).alias("m"), gives.alias("g"))

        def after(m: Column) -> Column:
            # give ends with a at 0 or b at 1; take ends with b at 0 or a at 1
            a_ends = F.when(m["g"], mass(a, a["p"]) <= mass(b, 1 - b["p"])).otherwise(mass(a, 1 - a["p"]) <= mass(b, b["p"]))
            pa = F.when(a_ends, F.when(m["g"], 0.0).otherwise(1.0)).otherwise(a["p"] + m["m"] / a["size"])
            pb = F.when(a_ends, b["p"] - m["m"] / b["size"]).otherwise(F.when(m["g"], 1.0).otherwise(0.0))
            pb = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pb))
            pa = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pa))
            return F.when(a_ends, F.struct(F.concat(acc["done"], F.array(fixed(a, pa))).alias("done"), fixed(b, pb).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(fixed(b, pb))).alias("done"), fixed(a, pa).alias("open")))

        pivot = F.transform(F.array(moved), after)[0]
        return F.when(b["p"].isin(0.0, 1.0), F.struct(F.concat(acc["done"], F.array(b)).alias("done"), a.alias("open"))).when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("open"))).otherwise(pivot)

    return F.aggregate(block, start, step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, block: int = 128, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row; taken is size times a whole number of copies, cap at most.

    Every document of a source is due target / source_size copies; the whole part is sure, the rest is a chance that
    pivots settle within blocks of about `block` documents of one source. What each block leaves open goes to the next
    level's blocks, until one document per source is open, which goes to the nearer end. The words taken from a source
    thus miss its target by half a document at most. Blocks depend on ids and sizes only, so reruns agree; equal rows are
    numbered. Null texts have size 0 and take nothing; null sources are one source, the last; a null id is an id like
    any other. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"), size.alias("size")), "sizes")
    targets = source_targets(sized, weights, cap)
    due = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    numbered = sized.groupBy("doc_id", "src", "size").count().select("doc_id", "src", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    rows = numbered.join(targets, numbered["src"].eqNullSafe(targets["src"])).drop(targets["src"]).withColumn("due", due)
    rows = rows.withColumns({"whole": F.floor("due"), "p": F.when(F.col("size") > 0, F.col("due") - F.floor("due")).otherwise(0.0), "h": F.xxhash64("doc_id", "src", "size", "copy", F.lit(seed))})
    fields = ["doc_id", "src", "size", "source_size", "target", "whole", "p", "h"]
    most = sized.groupBy("src").count().agg(F.max("count")).collect()[0][0] or 0  # one number
    open_rows, done, level = rows.select(*fields, (F.floor(F.col("n_docs") / block) + 1).alias("blocks")), [], 0
    while True:
        key = F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks"))
        grouped = open_rows.withColumn("block", key).groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("h", *fields[:-1]))).alias("items"), F.max("blocks").alias("blocks"))
        ordered = F.transform("items", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
        settled = materialize(grouped.select(_settle(ordered, seed + level).alias("s"), "blocks"), f"mix{level}")
        done.append(settled.select(F.inline("s.done")))
        left = settled.filter(F.col("s.open").isNotNull()).select("s.open.*", F.col("blocks").alias("had"))
        if most <= 1 or level > 20:
            break
        if most // block + 1 == 1:
            break
        most = most // block + 1
        open_rows = left.select(*fields, (F.floor(F.col("had") / block) + 1).alias("blocks"))
        level += 1
    done.append(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).select(*fields))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.round("p").cast("long")) * F.col("size")).alias("taken"), F.col("src").alias("source"), (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
