"""Every registered query runs; those with SQL agree with it."""

import pytest

from fleetgauge.plans import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["test_id", "channel", "idx", "start_at", "end_at"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
