"""Samples of labelled rows stay bounded however often an id, a row or a label is repeated."""

from latticework.llm import common, quality_votes, toxicity


def test_rows_of_a_frequent_id_are_bounded(spark):
    labels = spark.createDataFrame([(1, 1)] * 500 + [(k, k % 2) for k in range(2, 40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(1, "same")] * 3000 + [(k, f"own {k}") for k in range(2, 40)], "doc_id long, text string")
    chosen, rows = common.labelled_rows(docs, labels, 600)
    assert chosen.count() == len(set(chosen.collect())) <= 40
    got = [tuple(r) for r in rows.collect()]
    assert 100 < len(got) <= 1200 and len(set(got)) == len(got)
    assert sorted(got) == sorted(map(tuple, common.labelled_rows(docs, labels, 600)[1].collect()))


def test_all_rows_where_they_are_few(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "a" if k % 3 else None) for k in range(40)] * 2, "doc_id long, text string")
    assert common.labelled_rows(docs, labels, 60)[1].count() == 60


def test_models_learn_from_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 3, f"plain words {k} you are an idiot" if k % 2 else f"plain words {k}") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(3)], "doc_id long, quality int, toxic int")
    model = quality_votes.fit(docs, labels, 100)
    assert model is not None and len(model.labels) <= 200
    assert toxicity.score(docs, toxicity.fit(docs, labels, 100)).count() == 600
