"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from larkspur.operators import hijri
from larkspur.plans import catalogue, changes, records

QUERIES, ORACLES = catalogue.QUERIES | records.QUERIES | changes.QUERIES, catalogue.ORACLES | records.ORACLES | changes.ORACLES
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "orders", "events", "pages", "conversations", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, DIR)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    as_text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert as_text(tuple(r[c] for c in order) for r in got.collect()) == as_text(want.select(*order).fetchall())


def test_hijri_dates_match_their_sql(spark, con):
    want = con.sql(hijri.oracle(spark))
    got = QUERIES["hijri_dates"](spark, DIR)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert __spark_entry__.oracle_sql()["hijri_dates"] == hijri.oracle(spark)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"hijri_dates"}
