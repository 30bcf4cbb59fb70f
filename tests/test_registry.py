import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import compare

DATA = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_entry_returns_the_slot_mart(spark):
    assert contract.entry(spark).count() == 5 * 31 * 48 * 2


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, db, name):
    frame = contract.queries()[name](spark, str(DATA)).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(frame)
    else:
        assert compare(frame, db.execute(sql).df()).startswith("ok")
