"""Every query over the access log against its SQL."""

import pytest

import __spark_entry__ as contract
from check import same_rows, tables
from conftest import SMALL
from registry.oracle import ORACLE
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return tables(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_contract_holds_them_all():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    assert same_rows(got, duck.sql(ORACLE[name]).df()) == ""


def test_entry(spark):
    assert contract.entry(spark).columns == ["date", "domain", "requests"]
