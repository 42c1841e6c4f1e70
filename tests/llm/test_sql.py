"""Queries of operators that SQL can express, against DuckDB."""

import pytest
from oracle import same

from spindle.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, sf, name):
    same(LLM_QUERIES[name](spark, sf), sf, LLM_ORACLES[name])
