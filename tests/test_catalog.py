"""Every registered query of the library against its SQL; the store is written once and read by all."""

import pytest

from tessera.plans import catalog
from tessera.sources import store as stores
from tests.compare import engine, rows_of, sql_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def other(tiny):
    return engine(tiny)


@pytest.fixture(scope="module", autouse=True)
def written(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    stores.write(stores.fixture(spark, tiny), path, "overwrite")
    spark.conf.set(stores.STORE_DIR, path)
    yield
    spark.conf.unset(stores.STORE_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, other, name):
    got = rows_of(QUERIES[name](spark, tiny))
    if name in SQL:
        assert got == sql_rows(other, SQL[name])


@pytest.mark.parametrize("name", ["q5_row_changes", "l8b_draft_page_with_ties"])
def test_query_without_a_written_store(spark, tiny, other, name):
    path = spark.conf.get(stores.STORE_DIR)
    spark.conf.unset(stores.STORE_DIR)
    try:
        assert rows_of(QUERIES[name](spark, tiny)) == sql_rows(other, SQL[name])
    finally:
        spark.conf.set(stores.STORE_DIR, path)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
