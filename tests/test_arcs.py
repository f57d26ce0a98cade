from latticework import catalog

SF = "/root/testdata/sf0.001"


def test_arcs_join_all_consecutive_vectors(spark):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    per = catalog.queries()["arc_points"](spark, SF).groupBy("channel").count().collect()
    assert {r["channel"] for r in per} == {k for k in ids if k + 1 in ids} and {r["count"] for r in per} == {100}
