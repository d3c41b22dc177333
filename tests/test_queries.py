"""Every registered query against the SQL that states its result."""

import pytest
from compare import differences, duck

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(contract.queries()[name](spark, sf_dir), con, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
