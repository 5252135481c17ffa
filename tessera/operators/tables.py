"""Tables of a draft: created, renamed and given other schemas, with what follows in the system tables.

A table's schema is a row of `sys_schemas` under the table's name, whose meta lists the patches that led to it; every
change is an entry of the ledger `sys_migrations`; saved views are rows of `sys_views`. These rows are one a table, so
they are handled on the driver, in a store of their own; rows of tables never are.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.functions import views
from tessera.functions.jsonpath import foreign_key_paths, schema_type, with_target
from tessera.functions.schema import apply_patches, patched
from tessera.operators.scan import insert_rows
from tessera.operators.versioning import Refused, next_migration_id, rename_rows, rewrite_rows, touch_table, update_rows
from tessera.sources.store import ROW_COLUMNS, Store, rows_of, system_links, table_at

SCHEMAS, MIGRATIONS, VIEWS = "sys_schemas", "sys_migrations", "sys_views"
TABLE_ID, FIELD = re.compile(r"(?!__)[A-Za-z_][A-Za-z0-9_-]{0,63}"), re.compile(r"(?!__)[A-Za-z_][A-Za-z0-9_]{0,63}")
TYPES = ("string", "number", "boolean", "object", "array")
AfterMigrate = Callable[[DataFrame], DataFrame]


def text_of(document) -> str:
    return json.dumps(document, separators=(",", ":"), ensure_ascii=False)


def hash_of(document) -> str:
    return hashlib.md5(text_of(document).encode()).hexdigest()


def iso(now: int) -> str:
    return datetime.fromtimestamp(now / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now % 1000:03d}Z"


def checked_schema(schema: dict) -> None:
    """Refuses types that there aren't, and names that no field may have."""
    if "$ref" in schema:
        return
    if schema.get("type") not in TYPES:
        raise Refused(f"no type {schema.get('type')!r}")
    for name, sub in schema.get("properties", {}).items():
        if not FIELD.fullmatch(name):
            raise Refused(f"bad field name {name!r}")
        checked_schema(sub)
    if "items" in schema:
        checked_schema(schema["items"])


class Apart(Store):
    """A store's revisions and tables with the rows of one draft's system tables, all on the driver."""


LOCAL = ("revision", "table_version", "revision_table", "row_version", "row_table")


def _settled(store: Store) -> Store:
    """What was changed apart, worked out, so that plans of many changes don't pile up."""
    if not isinstance(store, Apart):
        return store
    spark = store.branch.sparkSession
    held = lambda df: spark.createDataFrame([tuple(r) for r in df.collect()], StructType([StructField(f.name, f.dataType) for f in df.schema]))
    return store.but(**{name: held(getattr(store, name)) for name in LOCAL})


def apart(store: Store, revision_id: str) -> Apart:
    links = system_links(store, revision_id)
    rows = store.row_version.filter(F.col("version_id").isin(sorted({r[0] for r in links}))).select(*ROW_COLUMNS)
    held = store.branch.sparkSession.createDataFrame([r[:2] for r in links], "row_version_id string, table_version_id string")
    return _settled(Apart(**vars(store)).but(row_version=rows, row_table=held))


def put_back(store: Store, before: Apart, after: Apart) -> Store:
    """The store with what changed apart: rows and links that differ, by name, and the revisions and tables."""
    spark = store.branch.sparkSession
    rows = lambda s: {r["version_id"]: r for r in s.row_version.select(*ROW_COLUMNS).collect()}
    links = lambda s: {(r["row_version_id"], r["table_version_id"]) for r in s.row_table.collect()}
    after = _settled(after)
    (old, new), (was, now) = (rows(before), rows(after)), (links(before), links(after))
    gone, tables = [v for v, r in old.items() if new.get(v) != r], sorted({t for _, t in was - now})
    row_version, row_table = store.row_version, store.row_table
    if gone:
        row_version = row_version.filter(~F.col("version_id").isin(gone))
    if tables:
        row_table = row_table.filter(~F.col("table_version_id").isin(tables))
    made = spark.createDataFrame([tuple(r) for v, r in new.items() if old.get(v) != r], after.row_version.select(*ROW_COLUMNS).schema)
    come = spark.createDataFrame(sorted(k for k in now if k not in was or k[1] in tables), "row_version_id string, table_version_id string")
    return store.but(**{name: getattr(after, name) for name in LOCAL[:3]}, row_version=row_version.unionByName(made), row_table=row_table.unionByName(come))


def on_system_rows(change: Callable[..., Store]) -> Callable[..., Store]:
    """A change that concerns system tables alone: made apart and put back, so that no plan over the rows of tables is run."""

    @functools.wraps(change)
    def run(store: Store, revision_id: str, *args, **more) -> Store:
        if isinstance(store, Apart):
            return change(store, revision_id, *args, **more)
        few = apart(store, revision_id)
        return put_back(store, few, change(few, revision_id, *args, **more))

    return run


def _draft(store: Store, revision_id: str) -> Store:
    """The store with the draft marked as changed; other revisions are refused."""
    if store.revision.filter((F.col("id") == revision_id) & F.col("is_draft")).isEmpty():
        raise Refused(f"{revision_id} is no draft")
    return store.but(revision=store.revision.withColumn("has_changes", F.col("has_changes") | (F.col("id") == revision_id)))


def _new_table(store: Store, revision_id: str, table_id: str, system: bool, now: int) -> tuple[Store, str]:
    spark, version = store.branch.sparkSession, f"{table_id}@{now}"
    table = spark.createDataFrame([(version, f"{table_id}+{now}", table_id, False, system, now, now)], store.table_version.schema)
    link = spark.createDataFrame([(revision_id, version)], store.revision_table.schema)
    return store.but(table_version=store.table_version.unionByName(table), revision_table=store.revision_table.unionByName(link)), version


def system_table(store: Store, revision_id: str, name: str, now: int) -> tuple[Store, str]:
    """A system table of a draft, made if it is missing and copied if it is readonly, and its version."""
    store = _draft(store, revision_id)
    version = table_at(store, revision_id, name)
    if version is None:
        return _new_table(store, revision_id, name, True, now)
    store = touch_table(store, revision_id, version, f"{version}@{now}")
    return store, table_at(store, revision_id, name)


def _row(store: Store, version: str, row_id: str):
    return rows_of(store, version).filter(F.col("id") == row_id).select("data", "meta").first()


def put_row(store: Store, version: str, row_id: str, data, now: int, meta=None) -> Store:
    """A system row with a new document, and meta if given; made if there is none."""
    spark, text = store.branch.sparkSession, text_of(data)
    if _row(store, version, row_id) is None:
        made = (f"{version}/{row_id}", f"{version}+{row_id}", row_id, False, text, text_of(meta if meta is not None else {}), hashlib.md5(text.encode()).hexdigest(), "h-system", now, now, now)
        return _settled(insert_rows(store, spark.createDataFrame([made], store.row_version.schema), version))
    changes = spark.createDataFrame([(row_id, text)], "id string, data string")
    return _settled(update_rows(store, version, changes if meta is None else changes.withColumn("meta", F.lit(text_of(meta))), now))


@on_system_rows
def add_entry(store: Store, revision_id: str, entry: dict, now: int) -> Store:
    """A ledger entry under the next id."""
    store, version = system_table(store, revision_id, MIGRATIONS, now)
    last = rows_of(store, version).agg(F.max("id")).first()[0]
    entry_id = next_migration_id(datetime.fromtimestamp(now / 1000, UTC), [], [last] if last else [])
    return put_row(store, version, entry_id, {**entry, "id": entry_id}, now)


def schema_of(store: Store, revision_id: str, table_id: str) -> tuple[dict, list[dict]]:
    """Schema of a table and the patches that led to it."""
    version = table_at(store, revision_id, SCHEMAS)
    row = _row(store, version, table_id) if version else None
    if row is None:
        raise Refused(f"{table_id} has no schema")
    meta = json.loads(row["meta"] or "[]")
    return json.loads(row["data"]), meta if isinstance(meta, list) else []


@on_system_rows
def create_table(store: Store, revision_id: str, table_id: str, schema: dict, now: int) -> Store:
    """A new empty table, its schema row and its `init` entry."""
    if not TABLE_ID.fullmatch(table_id):
        raise Refused(f"bad table name {table_id!r}")
    store = _draft(store, revision_id)
    if table_at(store, revision_id, table_id) is not None:
        raise Refused(f"{table_id} exists")
    checked_schema(schema)
    store, _ = _new_table(store, revision_id, table_id, False, now)
    store, version = system_table(store, revision_id, SCHEMAS, now)
    history = [{"patches": [{"op": "add", "path": "", "value": schema}], "hash": hash_of(schema), "date": iso(now)}]
    store = put_row(store, version, table_id, schema, now, history)
    return add_entry(store, revision_id, {"changeType": "init", "tableId": table_id, "hash": hash_of(schema), "schema": schema}, now)


@on_system_rows
def update_schema(store: Store, revision_id: str, table_id: str, patches: list[dict], now: int, ledger: bool = True) -> Store:
    """A table's schema after patches, with the patches added to its history, and an `update` entry unless it is a
    consequence of another change."""
    before, history = schema_of(store, revision_id, table_id)
    after = patched(before, patches)
    checked_schema(after)
    store, version = system_table(store, revision_id, SCHEMAS, now)
    store = put_row(store, version, table_id, after, now, [*history, {"patches": patches, "hash": hash_of(after), "date": iso(now)}])
    return add_entry(store, revision_id, {"changeType": "update", "tableId": table_id, "hash": hash_of(after), "patches": patches}, now) if ledger else store


def rename_table(store: Store, revision_id: str, table_id: str, next_id: str, now: int) -> Store:
    """A table under another name: its schema and views rows follow, as do the foreign keys of other schemas, and the
    ledger gets a `rename` entry."""
    if not TABLE_ID.fullmatch(next_id) or next_id == table_id:
        raise Refused(f"bad table name {next_id!r}")
    store = _draft(store, revision_id)
    version = table_at(store, revision_id, table_id)
    if version is None or table_at(store, revision_id, next_id) is not None:
        raise Refused(f"{table_id} is missing or {next_id} exists")
    store = touch_table(store, revision_id, version, f"{version}@{now}")
    version = table_at(store, revision_id, table_id)
    store = store.but(table_version=store.table_version.withColumn("id", F.when(F.col("version_id") == version, F.lit(next_id)).otherwise(F.col("id"))))
    return _rename_system_rows(store, revision_id, table_id, next_id, now)


@on_system_rows
def _rename_system_rows(store: Store, revision_id: str, table_id: str, next_id: str, now: int) -> Store:
    pair = store.branch.sparkSession.createDataFrame([(table_id, next_id)], "old_id string, new_id string")
    store, schemas = system_table(store, revision_id, SCHEMAS, now)
    store = _settled(rename_rows(store, schemas, pair, now))
    saved = table_at(store, revision_id, VIEWS)
    if saved is not None and _row(store, saved, table_id) is not None:
        store, saved = system_table(store, revision_id, VIEWS, now)
        store = _settled(rename_rows(store, saved, pair, now))
    for r in rows_of(store, schemas).select("id", "data").collect():  # tables
        schema = json.loads(r["data"])
        pointing = {p[0] for p, target in foreign_key_paths(schema) if target == table_id}
        if pointing:
            moved = with_target(schema, table_id, next_id)
            patches = [{"op": "replace", "path": f"/properties/{name}", "value": moved["properties"][name]} for name in schema["properties"] if name in pointing]
            store = update_schema(store, revision_id, r["id"], patches, now, ledger=False)
    return add_entry(store, revision_id, {"changeType": "rename", "tableId": table_id, "nextTableId": next_id}, now)


def update_table(store: Store, revision_id: str, table_id: str, patches: list[dict], now: int, after_migrate: AfterMigrate | None = None) -> Store:
    """A whole table under a patched schema: its rows typed once, rewritten in one projection and written as new versions,
    then its schema, ledger and views. `after_migrate` computes on the typed column `d` and keeps the others."""
    store = _draft(store, revision_id)
    version = table_at(store, revision_id, table_id)
    if version is None or not store.table_version.filter((F.col("version_id") == version) & F.col("system")).isEmpty():
        raise Refused(f"{table_id} is no table of users")
    store = touch_table(store, revision_id, version, f"{version}@{now}")
    few = apart(store, revision_id)
    before, _ = schema_of(few, revision_id, table_id)
    version = table_at(few, revision_id, table_id)
    rows, after = apply_patches(rows_of(store, version).withColumn("d", F.from_json("data", schema_type(before))), "d", before, patches)
    rows = after_migrate(rows) if after_migrate else rows
    store = rewrite_rows(store, version, rows.withColumns({"new_data": F.to_json("d"), "schema_hash": F.lit(hash_of(after))}), now)
    return put_back(store, few, _update_system_rows(few, revision_id, table_id, patches, after, now))


def _update_system_rows(store: Apart, revision_id: str, table_id: str, patches: list[dict], after: dict, now: int) -> Apart:
    store = update_schema(store, revision_id, table_id, patches, now)
    saved = table_at(store, revision_id, VIEWS)
    row = _row(store, saved, table_id) if saved else None
    if row is not None and (document := json.loads(row["data"])) != (moved := views.migrate(document, patches)):
        store = put_views(store, revision_id, table_id, moved, after, now)
    return store


@on_system_rows
def put_views(store: Store, revision_id: str, table_id: str, document: dict, schema: dict, now: int) -> Store:
    """The views document of a table, checked against its schema; the system table is made if it is missing."""
    wrong = views.problems(document, schema)
    if wrong:
        raise Refused("; ".join(wrong))
    store, version = system_table(store, revision_id, VIEWS, now)
    return put_row(store, version, table_id, document, now)
