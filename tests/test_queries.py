import pytest

from sparkloom.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    assert_same(registry.queries()[name](spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
