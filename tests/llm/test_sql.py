"""Queries against their DuckDB SQL."""

import pytest

from sparkloom.llm import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    assert_same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name], digits=None)
