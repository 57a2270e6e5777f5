"""Every registered query with a DuckDB text gives its rows."""

import parity
import pytest

from flowloom.plans.catalog import QUERIES
from flowloom.plans.oracles import ORACLE_SQL


@pytest.fixture(scope="module")
def con(small):
    return parity.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, small, con, name):
    assert parity.differences(QUERIES[name](spark, small), con, ORACLE_SQL[name]) == []


def test_every_text_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_and_registry_agree(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:3] == ["window_id", "kind", "source"]
