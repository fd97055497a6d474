"""Every registered query against its SQL check, on whole tables."""

import pytest

import __spark_entry__ as entry_module
from harness import compare

ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "parser" in df.columns and df.count() == 6
