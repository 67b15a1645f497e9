"""Queries that SQL can express, against DuckDB."""

import pytest

from granary.llm import queries as llm
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(llm.queries()[name](spark, SF_DIR), llm.oracle_sql()[name])
