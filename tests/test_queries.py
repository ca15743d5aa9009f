"""Every registered query against its SQL twin over the whole smallest data set."""

import pytest

import __spark_entry__ as entry

from .compare import check
from .conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    ok, text = check(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
