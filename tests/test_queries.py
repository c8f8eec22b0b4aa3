"""Every registered query against its DuckDB counterpart, on the smallest tables."""

from __future__ import annotations

import pytest

from quarry.plans import registry
from quarry.plans.compare import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, sf, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
