"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from tallyloom import oracle
from tallyloom import queries as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registered.registry()) == set(oracle.statements())
    assert set(registered.registry()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered.registry()))
def test_query_equals_sql(spark, con, name):
    findings, *_, rows = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert findings == {} and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
