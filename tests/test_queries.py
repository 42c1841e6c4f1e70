"""Every registered query of the graph engine against DuckDB."""

import pytest
from oracle import same

from spindle.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), sf, ORACLES[name])


def test_registry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 210
