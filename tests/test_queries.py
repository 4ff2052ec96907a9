"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as catalogue
from tests.compare import database, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, name, SF_DIR) is None


def test_entry_has_rows(spark):
    assert catalogue.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
