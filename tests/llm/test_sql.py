"""The queries that have SQL, against it."""

import pytest

from tessera.llm import queries
from tests.compare import engine, rows_of, sql_rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tiny, name):
    assert rows_of(queries.queries()[name](spark, tiny)) == sql_rows(engine(tiny), SQL[name])
