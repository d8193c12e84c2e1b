import duckdb
import pytest

import __spark_entry__ as entry
from quillion.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    answer = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    own = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert own == sorted(answer.fetchall(), key=repr)
