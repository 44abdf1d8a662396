"""Every query with SQL gives the same rows as that SQL."""

import os

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    names, got = spark_rows(entry.queries()[name](spark, SF_DIR))
    want_names, want = duck_rows(con, entry.oracle_sql()[name])
    assert sorted(names) == sorted(want_names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
