"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import difference, duck
from conftest import SF_DIR

from textwarden.plans.oracles import WITHOUT_SQL, oracle_queries
from textwarden.plans.registry import QUERIES

SQL = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL) | set(WITHOUT_SQL) and not set(SQL) & set(WITHOUT_SQL)


def test_contract():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""
