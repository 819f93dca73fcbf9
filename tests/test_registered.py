"""Every registered query runs; those with SQL give the same values."""

import threading

import pytest

import __spark_entry__ as registered
from tests.compare import differences


def test_every_sql_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_has_rows(spark):
    df = registered.entry(spark)
    assert df.count() > 0
    assert "item_name" in df.columns and "top_rate" in df.columns


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, duck, small, name):
    got = registered.queries()[name](spark, small).toPandas()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    guard = threading.Timer(60, duck.interrupt)
    guard.start()
    expected = duck.execute(sql).fetchdf()
    guard.cancel()
    assert differences(got, expected) is None
