"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, sf_dir, connection, name):
    result = contract.queries()[name](spark, sf_dir)
    assert differences(result, contract.oracle_sql()[name], connection) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    assert not contract.queries()[name](spark, sf_dir).isEmpty()


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()
