"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from roomflow.plans import ORACLE, QUERIES
from tools.oracle_check import TABLES, rows

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "room_id", "booked_minutes", "available_minutes", "utilization_pct"]
    assert df.count() > 0


def test_upsell_rules_match_their_oracle(spark):
    # with the 150 tenants of the smallest tables nearly every set of products is frequent
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()["upsell_rules"](spark, sf).toPandas()
    want = c.execute(entry.oracle_sql()["upsell_rules"]).fetchdf()
    assert rows(got) == rows(want) and len(got) > 10_000


@pytest.mark.parametrize("name", [n for n in NAMES if n != "upsell_rules"])
def test_query_matches_oracle(spark, con, sf_small, name):
    got = entry.queries()[name](spark, sf_small).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
