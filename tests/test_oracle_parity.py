"""Every registered query equals its DuckDB oracle on the smallest provided tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from hearth import registry
from tools.compare import BASE, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="provided tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for b in BASE:
        p = f"{SF}/{b}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {b} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_fixture_bill_ids_are_unique(spark, sf):
    from hearth.sources.parquet import load_estate
    bills = load_estate(spark, f"/root/testdata/{sf}")["fee_records"]
    assert bills.groupBy("fee_id").count().filter("count > 1").isEmpty()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "payment_rate" in df.columns
