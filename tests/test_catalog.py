"""Every query with SQL gives the same rows in both engines."""

import glob
import os

import pytest

from subsetlab.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    answer = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = [tuple(r[i] for i in order) for r in answer.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_queries_without_sql(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        # The experiment scores draws from the 501st on, which this table hasn't.
        assert (catalog.queries()[name](spark, FOLDER).count() > 0) == (name != "baseline_experiment")
