"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from oracle_check import TESTDATA, compare, connect

import __spark_entry__ as entry

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["recall"] > 0.9


def test_counterparts_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    equal, rows, note = compare(spark, con, name, SF_DIR)
    assert equal, note
    assert rows
