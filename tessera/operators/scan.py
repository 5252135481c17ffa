"""Reads of branches, revisions, tables, rows, ledgers and views, and sinks for rows and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import compile_order, compile_where, remap
from tessera.functions.paging import Page, decode_cursor, keyset_page
from tessera.functions.plugins import Plugin, computed
from tessera.sources.store import Store, links_of, revision_rows, rows_of, table_at, tables_of

DEFAULT_VIEWS = '{"version":1,"defaultViewId":"default","views":[{"id":"default","name":"Default"}]}'


def list_tables(store: Store, revision_id: str, system: bool | None = False) -> DataFrame:
    return tables_of(store, revision_id, system)


def row_by_id(store: Store, revision_id: str, table_id: str, row_id: str) -> DataFrame:
    """A row by (revision, table, id): the table's links are narrowed first."""
    tables = tables_of(store, revision_id, None).filter(F.col("id") == table_id).select(F.col("version_id").alias("table_version_id"))
    links = store.row_table.join(tables, "table_version_id").select(F.col("row_version_id").alias("version_id"))
    return store.row_version.filter(F.col("id") == row_id).join(links, "version_id", "left_semi")


def count_rows(store: Store, table_version: str) -> DataFrame:
    """One row: how many rows a table version links, from links alone."""
    return links_of(store, table_version).agg(F.count("*").alias("n_rows"))


def get_rows(store: Store, revision_id: str, table_id: str, first: int, cursor: str | None = None, where: dict | None = None, order: list[dict] | None = None, schema: dict | None = None, plugins: list[Plugin] | None = None) -> tuple[Page, DataFrame]:
    """A keyset page of a table's rows and, apart, their total; links narrow the rows before documents are read. With
    plugins, the rows of the page (and they alone) are typed by the schema as `d` and computed."""
    version = table_at(store, revision_id, table_id)
    rows = rows_of(store, version) if version else store.row_version.limit(0)
    rows = rows.filter(compile_where(remap(where, schema or {})))
    parts = compile_order(order)
    page = keyset_page(rows, parts, first, decode_cursor(cursor, order))
    if plugins is not None:
        page.rows = computed(page.rows, schema or {"type": "object", "properties": {}}, plugins)
    return page, rows.agg(F.count("*").alias("total"))


def branch_heads(store: Store, project_id: str) -> DataFrame:
    """Branches of a project with their start, head and draft revisions, and whether the draft has changes."""
    r = store.revision.groupBy("branch_id").agg(
        F.max(F.when(F.col("is_start"), F.col("id"))).alias("start_id"), F.max(F.when(F.col("is_head"), F.col("id"))).alias("head_id"),
        F.max(F.when(F.col("is_draft"), F.col("id"))).alias("draft_id"), F.bool_or(F.col("is_draft") & F.col("has_changes")).alias("touched"),
    )
    return store.branch.filter(F.col("project_id") == project_id).join(r.withColumnRenamed("branch_id", "id"), "id", "left")


def migrations(store: Store, revision_id: str) -> DataFrame:
    """The ledger of a revision in the order of its ids."""
    return revision_rows(store, revision_id, True).filter("table_id = 'sys_migrations'").orderBy("id")


def table_views(store: Store, revision_id: str, table_id: str) -> DataFrame:
    """One row: the views document of a table, or the default one."""
    found = revision_rows(store, revision_id, True).filter((F.col("table_id") == "sys_views") & (F.col("id") == table_id))
    return found.agg(F.coalesce(F.max("data"), F.lit(DEFAULT_VIEWS)).alias("views"))


def child_branches(store: Store, revision_id: str) -> DataFrame:
    """Branches whose start revision comes from a revision."""
    starts = store.revision.filter(F.col("is_start") & (F.col("parent_id") == revision_id)).select(F.col("branch_id").alias("id"), F.col("id").alias("start_id"))
    return store.branch.join(starts, "id")


def parent_branches(store: Store) -> DataFrame:
    """Each branch and the branch and revision that it forks from."""
    starts = store.revision.filter("is_start").select(F.col("branch_id").alias("id"), F.col("parent_id").alias("from_revision"))
    parents = store.revision.select(F.col("id").alias("from_revision"), F.col("branch_id").alias("from_branch"))
    return store.branch.join(starts, "id").join(parents, "from_revision", "left")


def insert_rows(store: Store, rows: DataFrame, table_version: str) -> Store:
    """The store with new row versions and their links."""
    links = rows.select(F.col("version_id").alias("row_version_id"), F.lit(table_version).alias("table_version_id"))
    return store.but(row_version=store.row_version.unionByName(rows), row_table=store.row_table.unionByName(links))


def copied_links(store: Store, from_version: str, to_version: str, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Links of one table version for another, less the removed row versions, with the added."""
    kept = links_of(store, from_version).join(removed.select("version_id"), "version_id", "left_anti").unionByName(added.select("version_id"))
    return kept.select(F.col("version_id").alias("row_version_id"), F.lit(to_version).alias("table_version_id"))
