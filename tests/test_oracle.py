"""Every registered query against its DuckDB oracle through the driver
contract (__spark_entry__.queries / oracle_sql, doubles reported to 1e-6),
compared exactly (sf0.001 for speed; the driver gate runs sf0.01), plus the
entry-point contract."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tripframe.plans import check
from tripframe.plans.check import TABLES, compare

QUERIES, ORACLE = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name, monkeypatch):
    monkeypatch.setattr(check, "EXACT", True)
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    msg = compare(got, want)
    assert msg is None, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
