"""Every registered query beside its SQL."""

import pytest

import __spark_entry__ as contract
from tests.check_queries import difference, expected_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, expected_rows(contract.oracle_sql()[name], FOLDER)) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
