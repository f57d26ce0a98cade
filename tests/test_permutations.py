import numpy as np

from latticework import catalog

SF = "/root/testdata/sf0.001"


def test_permutations_take_in_all_labels(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, odd = np.stack(e["embedding"]).astype(float), (e["label"] % 2 == 1).to_numpy()
    want = x[~odd].mean(axis=0) - x[odd].mean(axis=0)
    got = catalog.queries()["permutation_maxstat"](spark, SF).toPandas().sort_values("feature")
    assert np.allclose(got["diff"], want, atol=1e-8) and got["p"].between(1 / 201 - 1e-9, 1).all()
