"""Quality rules: divergence of a text's character classes and common words from its language's references. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import WORD, materialize, table

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
}
#: Upper-case letters, digits, sentence marks; lower-case letters come before them, white space and all else after.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]")
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the text, the first included.

    Windows are hashed. Only where some are equal are they put in order with their positions: those with an equal
    neighbour occur again, and their positions, in order, cover min(3, gap to the next) words each.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0))))
    again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    placed = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("p"))))
    count = lambda w: let(F.sort_array(let(placed(w), lambda s: F.transform(again(s), lambda x: x["p"]))), covered)
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(count(w))).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, words, rest and the counts of the plain rules. A null text has no word, line or symbol. rest is the text without white space and lower-case letters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    out = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    out = out.select("*", words.alias("words"), F.regexp_replace("text", r"[\x20\x09-\x0D\p{Ll}]+", "").alias("rest"))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return out.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_dup.alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def known_words(references: dict[str, list[str]] = COMMON_WORDS) -> list[str]:
    return sorted({w for x in references.values() for w in x})


def histograms(df: DataFrame, references: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """Adds chars, the counts of the character classes (lower case, CLASSES, white space, all else), and hits, how often each known word comes in the text, in order.

    The common words are put in one string, each between spaces of its own; what taking one out shortens it by tells its
    number.
    """
    own = [F.length("rest") - F.length(F.regexp_replace("rest", f"(?:{c})+", "")) for c in CLASSES]
    chars = [F.col("word_chars") - F.length("rest"), *own, F.length("text") - F.col("word_chars")]
    df = df.withColumn("chars", F.array(*[c.cast("double") for c in chars]))
    df = df.withColumn("chars", F.concat("chars", F.array(F.length("text") - F.aggregate("chars", F.lit(0.0), lambda s, x: s + x))))
    known = known_words(references)
    plain = lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))
    common = F.transform(F.filter("words", lambda w: plain(w).isin(known)), plain)
    df = df.withColumn("common", F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")))
    times = [((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in known]
    return df.withColumn("hits", F.array(*times)).drop("common", "rest")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(c, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def word_shares(hits: Column, n_words: Column, words: list[str], known: list[str]) -> Column:
    """Shares of each of the words, the last for all other words."""
    own = [F.get(hits, F.lit(known.index(w))).cast("double") for w in words]
    rest = F.greatest(F.lit(0.0), n_words - total(hits, words, known))
    return let(F.greatest(F.lit(1.0), n_words.cast("double")), lambda n: F.array(*[c / n for c in own], rest / n))


def total(hits: Column, words: list[str], known: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.get(hits, F.lit(known.index(w)))
    return out


def language_references(digest: DataFrame, references: dict[str, list[str]] = COMMON_WORDS) -> dict[str, tuple[list[float], list[float]]]:
    """Per language: the means of the character classes' shares over its digests of 50 words and more, and the shares of its common words in all their words."""
    h = digest.filter(F.col("lang").isin(list(references)) & (F.col("n_words") >= 50)).withColumn("share", shares(F.col("chars")))
    n, known = len(CLASSES) + 3, known_words(references)
    sums = [F.sum(F.get("hits", F.lit(k))).alias(f"w{k}") for k in range(len(known))]
    rows = h.groupBy("lang").agg(F.sum("n_words").alias("words"), *[F.avg(F.get("share", F.lit(i))).alias(f"c{i}") for i in range(n)], *sums).collect()  # a row per language
    out = {}
    for r in rows:
        own = [r[f"w{known.index(w)}"] / r["words"] for w in references[r["lang"]]]
        out[r["lang"]] = ([r[f"c{i}"] for i in range(n)], [*own, 1 - sum(own)])
    return out


def judge(docs: DataFrame, references: dict[str, list[str]] = COMMON_WORDS, char_limit: float = 0.25, word_limit: float = 0.33, min_words: int = 50, word_guard: int = 150) -> DataFrame:
    """doc_id, the counts, base_failed, kept, char_distance, word_distance and the nearest reference's language.

    A text is compared to the reference of the language whose common words it has most of. It is kept if its
    character classes, and from `word_guard` words on its common words too, lie within the limits; below `min_words`
    base_failed already decides. Texts are read once: their counts and histograms are written, and the references and
    the verdicts come from these. Null, empty and blank texts have no word and fail. Rows are independent of each other;
    texts of any length count whole, other columns don't matter, and an empty table gives an empty result.
    """
    df = materialize(histograms(base_counts(docs), references).drop("text", "words"), "digests")
    ref = language_references(df, references)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    names = sorted(ref)
    if names:
        known = known_words(references)
        hit = [total(F.col("hits"), references[n], known) for n in names]
        best = F.greatest(*hit) if len(hit) > 1 else hit[0]
        nearest = F.lit(names[-1])
        for n, h in reversed(list(zip(names, hit, strict=True))):
            nearest = F.when(h == best, F.lit(n)).otherwise(nearest)
        df = df.withColumn("nearest", nearest).withColumn("char_shares", shares(F.col("chars")))
        pick = lambda f: F.coalesce(*[F.when(F.col("nearest") == n, f(n)) for n in names])
        df = df.withColumn("char_distance", pick(lambda n: divergence(F.col("char_shares"), F.array(*map(F.lit, ref[n][0])))))
        df = df.withColumn("word_distance", pick(lambda n: divergence(word_shares(F.col("hits"), F.col("n_words"), references[n], known), F.array(*map(F.lit, ref[n][1])))))
    else:
        df = df.withColumns({"nearest": F.lit(None).cast("string"), "char_distance": F.lit(0.0), "word_distance": F.lit(0.0)})
    close = (F.col("char_distance") <= char_limit) & ((F.col("n_words") < word_guard) | (F.col("word_distance") <= word_limit))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ((F.col("n_words") < min_words) | close)).alias("kept"), F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"), "nearest")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    listed = ", ".join(f"('{n}', {k}, '{w}')" for n, words in COMMON_WORDS.items() for k, w in enumerate(words))
    counts = ", ".join(f"CAST(len(regexp_extract_all(t, '{c.replace(chr(39), chr(39) * 2)}')) AS DOUBLE)" for c in (r"\p{Ll}", *CLASSES, r"[\x20\x09-\x0D]"))
    divergence = "sqrt(greatest(0.0, sum(CASE WHEN p>0 THEN p*log2(2*p/(p+q))/2 ELSE 0 END + CASE WHEN q>0 THEN q*log2(2*q/(p+q))/2 ELSE 0 END)))"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
ws AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x<>'') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, [{counts}] AS c FROM d),
pos AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words)+1)) AS p FROM ws),
win AS (SELECT r, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM pos WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM win WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p+k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) WHERE n>1 GROUP BY r),
base AS MATERIALIZED (SELECT ws.r, doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t)-length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines)-len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, list_append(c, greatest(0.0, length(t)-list_sum(c))) AS chars FROM ws LEFT JOIN rep ON ws.r=rep.r),
ref AS (SELECT * FROM (VALUES {listed}) v(ln, k, word)),
cnt AS MATERIALIZED (SELECT r, ln, k, count(*) AS n FROM pos JOIN ref ON rtrim(lower(w), '.,;:!?')=word GROUP BY ALL),
sh AS MATERIALIZED (SELECT r, lang, n_words, unnest(range(0, len(chars))) AS i, unnest(list_transform(chars, lambda x: CASE WHEN list_sum(chars)>0 THEN x/list_sum(chars) ELSE 0.0 END)) AS p FROM base),
rc AS (SELECT lang AS ln, i, avg(p) AS q FROM sh WHERE n_words>=50 AND lang IN (SELECT ln FROM ref) GROUP BY ALL),
rt AS (SELECT lang AS ln, sum(n_words) AS t FROM base WHERE n_words>=50 GROUP BY ALL),
rk AS (SELECT ref.ln, ref.k, coalesce(sum(n) FILTER (b.n_words>=50 AND b.lang=ref.ln), 0)/any_value(rt.t) AS q FROM ref JOIN rt ON ref.ln=rt.ln LEFT JOIN cnt ON cnt.ln=ref.ln AND cnt.k=ref.k LEFT JOIN base b ON b.r=cnt.r GROUP BY ref.ln, ref.k),
rw AS (SELECT * FROM rk UNION ALL SELECT ln, -1, 1-sum(q) FROM rk GROUP BY ln),
tot AS (SELECT b.r, l.ln, coalesce(sum(cnt.n), 0) AS n FROM base b CROSS JOIN (SELECT DISTINCT ln FROM rc) l LEFT JOIN cnt ON cnt.r=b.r AND cnt.ln=l.ln GROUP BY ALL),
near AS MATERIALIZED (SELECT r, ln, n AS own FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, ln) AS k FROM tot) WHERE k=1),
cd AS (SELECT r, {divergence} AS char_distance FROM (SELECT sh.r, p, q FROM sh JOIN near ON sh.r=near.r JOIN rc ON rc.ln=near.ln AND rc.i=sh.i) GROUP BY r),
wd AS (SELECT r, {divergence} AS word_distance FROM (SELECT near.r, CASE WHEN rw.k<0 THEN greatest(0, b.n_words-own) ELSE coalesce(cnt.n, 0) END/greatest(1.0, b.n_words) AS p, q FROM near JOIN base b ON b.r=near.r JOIN rw ON rw.ln=near.ln LEFT JOIN cnt ON cnt.r=near.r AND cnt.ln=near.ln AND cnt.k=rw.k) GROUP BY r),
v AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed FROM base JOIN near USING (r) JOIN cd USING (r) JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND char_distance<=0.25 AND (n_words<150 OR word_distance<=0.33) AS kept, round(char_distance, 9) AS char_distance, round(word_distance, 9) AS word_distance, ln AS nearest FROM v
"""


#: DuckDB SQL for the rows of op10_quality_rules.
ORACLE = _sql()
