"""Every query with an oracle against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from chronoframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(repr, r)) for r in found.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
