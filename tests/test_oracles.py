"""Every registered query against its SQL in DuckDB, as the driver compares them."""

import os

import duckdb
import pytest

from lexweave import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", engine.oracle_sql())
def test_query_equals_sql(spark, con, name):
    df = engine.queries()[name](spark, DATA)
    cur = con.execute(engine.oracle_sql()[name])
    expected = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, df.collect()) == expected
    if not name.endswith("missing"):
        assert expected[1], "the query finds nothing"


def test_other_queries_run(spark):
    for name in set(engine.queries()) - set(engine.oracle_sql()):
        assert engine.queries()[name](spark, DATA).columns


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
