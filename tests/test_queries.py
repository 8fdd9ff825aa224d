"""Every registered query against its SQL, on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from workload import REGISTRY
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
#: Queries that SQL cannot say, with tests of their own elsewhere.
NO_SQL = {"compose_tight"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["l_returnflag"] for r in sorted(rows)] == ["A", "N", "R"]


def test_every_query_has_sql():
    assert set(SQL) >= set(REGISTRY) - NO_SQL
