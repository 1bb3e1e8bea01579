"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_points
from workload.registry import QUERIES
from workload.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    sql = entry_points.oracle_sql()[name]
    found, _ = differences(spark, sf_dir, entry_points.queries()[name], sql, con)
    assert found == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
