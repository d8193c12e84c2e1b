import re

import __spark_entry__ as entry
import pytest
from quillion.plans.catalog import SQL

DATA = "/root/testdata/sf0.001"


def test_nulls_last_ranks_the_whole_table(spark):
    rows = entry.queries()["order_nulls_last"](spark, DATA).collect()
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert len(rows) == orders.count() > 200
    owner = {r["o_orderkey"]: r["o_custkey"] for r in orders.collect()}
    places: dict = {}
    for r in rows:
        places.setdefault(owner[r["k"]], []).append((r["pos"], r["x"] is None))
    assert all([null for _, null in sorted(p)] == sorted(null for _, null in p) for p in places.values())


@pytest.mark.parametrize("name", ["order_nulls_last", "cast_exprs"])
def test_no_id_subset(name):
    assert not re.search(r"key\s*<", SQL[name])
