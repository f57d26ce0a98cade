from collections import Counter

import corpus_pipeline as c

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n):
    return [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(n)]


def test_different_texts_that_share_an_id_stay(spark):
    rows = [(None if k % 3 else 7, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts(60))]
    again = [(None, rows[0][1], "en", "a", 1), rows[1], rows[1]]
    got = c.drop_near_duplicates(spark, spark.createDataFrame(rows + again, SCHEMA), SF).collect()
    assert Counter(map(tuple, got)) == Counter(rows)


def test_mixing_repeats_each_row_by_itself(spark):
    rows = [(None, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(texts(90))]
    got = Counter(r["text"] for r in c.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    assert max(got.values()) <= 3 and sum(got.values()) <= 2 * len(rows)
    twice = Counter(r["text"] for r in c.mix_sources(spark, spark.createDataFrame(rows + rows, SCHEMA), SF).collect())
    assert max(twice.values()) <= 6 and sum(twice.values()) <= 4 * len(rows)
