"""Every query of the catalog against its SQL at the smallest scale."""

import duckdb
import pytest

from latticework import catalog

SF = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v != v else round(v + 0.0, 6) if isinstance(v, float) else v
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
