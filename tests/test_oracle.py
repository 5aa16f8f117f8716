"""Every registered query with an SQL counterpart gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from argosift.plans.views import TABLES
from check import canonical

QUERIES, ORACLES = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    rows = {r["status"]: r["records"] for r in E.entry(spark).collect()}
    assert set(rows) <= {"valid", "hash_mismatch", "missing_in_primary", "missing_in_backup"} and rows["valid"] > 0


def test_oracle_names_are_queries():
    assert set(ORACLES) <= set(QUERIES)
