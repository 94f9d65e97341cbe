"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from rollbook.plans import catalog
from tests.oracle import connect, spark_rows, sql_rows

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    with connect(FOLDER) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    columns, rows = spark_rows(contract.queries()[name](spark, FOLDER))
    expected_columns, expected = sql_rows(connection, contract.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(contract.queries())
