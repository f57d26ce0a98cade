import numpy as np

from latticework.llm import neighbours


def exact(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


def test_far_vectors_and_small_tables_get_whole_lists(spark):
    rng = np.random.default_rng(3)
    for n in (7, 900):
        x = rng.standard_normal((n, 16))
        x[::100] *= 80
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = neighbours.search(df).toPandas()
        for q in range(0, n, 100):
            own = got[got["query_id"] == q].sort_values("rank")
            assert own["vec_id"].tolist() == exact(x, q)
