"""Registered queries equal their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import TESTDATA, compare, connect

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, name):
    problems = compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert [p for p in problems if p != "no rows"] == []
