"""State transitions of the version store, as functions from tables to tables."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import rewritten, steps
from tessera.operators.diff import has_row_diffs, has_table_diffs
from tessera.operators.references import references
from tessera.sources.store import ROW_COLUMNS, Store, dealt, links_of, parts_for, rows_of, tables_of


#: Lengths of an ISO time to the day and to the second.
DAY, SECOND = 10, 19


class Refused(ValueError):
    """A transition that the store's rules don't allow."""


def touch_table(store: Store, revision_id: str, table_version: str, new_version: str) -> Store:
    """Copy on write of a table in a draft: a new version with the same identity, the same links, and the revision relinked."""
    t = store.table_version.filter(F.col("version_id") == table_version)
    row = t.select("readonly").first()
    if row is None:
        raise Refused(f"no table version {table_version}")
    if not row[0]:
        return store
    made = t.withColumns({"version_id": F.lit(new_version), "readonly": F.lit(False)})
    links = links_of(store, table_version).select(F.col("version_id").alias("row_version_id"), F.lit(new_version).alias("table_version_id"))
    here = (F.col("revision_id") == revision_id) & (F.col("table_version_id") == table_version)
    relinked = store.revision_table.withColumn("table_version_id", F.when(here, F.lit(new_version)).otherwise(F.col("table_version_id")))
    return store.but(table_version=store.table_version.unionByName(made), row_table=store.row_table.unionByName(links), revision_table=relinked)


def touched_rows(store: Store, table_version: str, ids: DataFrame, version_of: Column) -> DataFrame:
    """Copies of the readonly rows of some ids under new versions; identity, hash and times stay."""
    rows = rows_of(store, table_version).join(ids.select("id").distinct(), "id", "left_semi").filter("readonly")
    return rows.withColumns({"old_version_id": F.col("version_id"), "version_id": version_of, "readonly": F.lit(False)})


def update_rows(store: Store, table_version: str, changes: DataFrame, now: int) -> Store:
    """Rows of a draft table with new documents: changes (id, data, and meta or schema_hash if they change too). Readonly
    rows are copied first, others change in place."""
    more = [c for c in ("meta", "schema_hash") if c in changes.columns]
    mine = rows_of(store, table_version).drop(*more).join(changes.select("id", F.col("data").alias("new_data"), *more), "id")
    return rewrite_rows(store, table_version, mine, now)


def rewrite_rows(store: Store, table_version: str, mine: DataFrame, now: int) -> Store:
    """`update_rows` for rows that carry their document as `new_data` already, without a join by id."""
    return _swap(store, table_version, mine.withColumns({"data": F.col("new_data"), "hash": F.md5("new_data")}), now)


def rename_rows(store: Store, table_version: str, pairs: DataFrame, now: int) -> Store:
    """Rows with new ids: pairs (old_id, new_id); identity and content stay."""
    mine = rows_of(store, table_version).join(pairs.withColumnRenamed("old_id", "id"), "id")
    return _swap(store, table_version, mine.withColumn("id", F.col("new_id")), now)


def _swap(store: Store, table_version: str, changed: DataFrame, now: int) -> Store:
    """Changed rows of one table version in place of those that it holds: readonly ones as copies to which its links are
    moved, others under their own version. The two are apart, so that what is asked of a new version's id is asked of the
    old one's and of its link before they are joined; links of other tables and readonly rows aren't compared at all."""
    here, locked = F.col("table_version_id") == table_version, F.coalesce("readonly", F.lit(False))
    changed = changed.withColumn("updated_at", F.lit(now).cast("long"))
    new_version = F.concat("version_id", F.lit(f"@{now}"))
    copies, others = changed.filter(locked), changed.filter(~locked)
    moved = copies.select(F.col("version_id").alias("row_version_id"), new_version.alias("new_version_id"))
    own = store.row_table.filter(here).join(moved, "row_version_id", "left").select(F.coalesce("new_version_id", "row_version_id").alias("row_version_id"), "table_version_id")
    kept = store.row_version.filter(locked).unionByName(store.row_version.filter(~locked).join(others.select("version_id"), "version_id", "left_anti"))
    made = [part.withColumn("readonly", F.lit(False)).select(*ROW_COLUMNS) for part in (copies.withColumn("version_id", new_version), others)]
    return store.but(row_version=kept.unionByName(made[0]).unionByName(made[1]), row_table=store.row_table.filter(~here).unionByName(own))


def remove_rows(store: Store, table_version: str, ids: DataFrame) -> Store:
    """Rows unlinked from a table; those that aren't readonly are deleted."""
    gone = rows_of(store, table_version).join(ids.select("id").distinct(), "id", "left_semi")
    links = store.row_table.join(gone.select(F.col("version_id").alias("row_version_id"), F.lit(table_version).alias("table_version_id")), ["row_version_id", "table_version_id"], "left_anti")
    return store.but(row_table=links, row_version=store.row_version.join(gone.filter("not readonly").select("version_id"), "version_id", "left_anti"))


def blocking_references(removed: DataFrame, referrers: DataFrame, paths: list[list[str]]) -> DataFrame:
    """References from other rows to ids about to be removed; rows removed themselves don't count."""
    rest = referrers.join(removed.select("version_id"), "version_id", "left_anti")
    return references(rest, paths).join(removed.select(F.col("id").alias("target")), "target", "left_semi")


def remove_table(store: Store, revision_id: str, table_version: str) -> Store:
    """A table unlinked from a draft; if it isn't readonly it goes, with its rows that no other table holds."""
    here = (F.col("revision_id") == revision_id) & (F.col("table_version_id") == table_version)
    out = store.but(revision_table=store.revision_table.filter(~here))
    if store.table_version.filter((F.col("version_id") == table_version) & ~F.col("readonly")).isEmpty():
        return out
    mine = links_of(store, table_version)
    others = store.row_table.filter(F.col("table_version_id") != table_version).select(F.col("row_version_id").alias("version_id"))
    parts = parts_for(store.row_table)
    gone = dealt(mine, parts, "version_id").join(dealt(others, parts, "version_id"), "version_id", "left_anti")
    return out.but(table_version=store.table_version.filter(F.col("version_id") != table_version), row_table=store.row_table.filter(F.col("table_version_id") != table_version), row_version=store.row_version.join(gone, "version_id", "left_anti"))


def commit(store: Store, branch_id: str, new_draft: str) -> Store:
    """The draft becomes head, a new draft opens with its links, and what the draft owned is locked."""
    r = store.revision
    mine = F.col("branch_id") == branch_id
    draft = r.filter(mine & F.col("is_draft")).first()
    if draft is None or not draft["has_changes"]:
        raise Refused("the draft has no changes")
    last = r.agg(F.max("sequence")).first()[0]
    revisions = r.withColumns({"is_head": F.when(mine, F.col("is_draft")).otherwise(F.col("is_head")), "is_draft": F.when(mine, F.lit(False)).otherwise(F.col("is_draft"))})
    revisions = revisions.withColumn("has_changes", F.when(F.col("id") == draft["id"], F.lit(False)).otherwise(F.col("has_changes")))
    opened = r.filter(F.col("id") == draft["id"]).withColumns({"id": F.lit(new_draft), "sequence": F.lit(last + 1), "parent_id": F.lit(draft["id"]), "is_head": F.lit(False), "is_draft": F.lit(True), "is_start": F.lit(False), "has_changes": F.lit(False)})
    links = store.revision_table.filter(F.col("revision_id") == draft["id"])
    tables = tables_of(store, draft["id"], None).filter("not readonly").select("version_id", F.lit(True).alias("owned"))
    rows = store.row_table.join(tables.select(F.col("version_id").alias("table_version_id")), "table_version_id").select(F.col("row_version_id").alias("version_id"), F.lit(True).alias("owned")).distinct()
    lock = lambda df, owned: df.join(owned, "version_id", "left").withColumn("readonly", F.col("readonly") | F.coalesce("owned", F.lit(False))).drop("owned")
    return store.but(revision=revisions.unionByName(opened), revision_table=store.revision_table.unionByName(links.withColumn("revision_id", F.lit(new_draft))), table_version=lock(store.table_version, tables), row_version=lock(store.row_version, rows))


def revert(store: Store, head: str, draft: str) -> Store:
    """The draft's links are the head's again."""
    links = store.revision_table.filter(F.col("revision_id") != draft)
    back = store.revision_table.filter(F.col("revision_id") == head).withColumn("revision_id", F.lit(draft))
    revision = store.revision.withColumn("has_changes", F.when(F.col("id") == draft, F.lit(False)).otherwise(F.col("has_changes")))
    return store.but(revision_table=links.unionByName(back), revision=revision)


def recompute_has_changes(store: Store, head: str, draft: str) -> tuple[Store, bool]:
    """Draft tables without row changes are the head's again; then whether the draft differs at all."""
    side = lambda r, n: tables_of(store, r, None).select("created_id", F.col("id").alias(f"{n}_id"), F.col("version_id").alias(n))
    both = side(head, "a").join(side(draft, "b"), "created_id").filter("a <> b and a_id = b_id").collect()  # tables, not rows
    idle = {r["b"]: r["a"] for r in both if not has_row_diffs(store, head, draft, r["created_id"]).first()[0]}
    if idle:
        back = F.create_map(*[F.lit(x) for pair in idle.items() for x in pair])
        store = store.but(revision_table=store.revision_table.withColumn("table_version_id", F.when(F.col("revision_id") == draft, F.coalesce(F.element_at(back, F.col("table_version_id")), F.col("table_version_id"))).otherwise(F.col("table_version_id"))))
    return store, has_table_diffs(store, head, draft).first()[0]


def create_branch(store: Store, branch_id: str, name: str, project_id: str, source: str) -> Store:
    """A branch that starts at a committed revision: its head and draft share the source's tables."""
    found = store.revision.filter(F.col("id") == source).first()
    if found is None or found["is_draft"]:
        raise Refused("a branch starts at a committed revision")
    if not store.branch.filter((F.col("project_id") == project_id) & (F.col("name") == name)).isEmpty():
        raise Refused(f"branch {name} exists")
    last = store.revision.agg(F.max("sequence")).first()[0]
    spark = store.branch.sparkSession
    branch = spark.createDataFrame([(branch_id, project_id, name, False)], store.branch.schema)
    revisions = spark.createDataFrame([(f"{branch_id}-head", last + 1, branch_id, source, True, False, True, False), (f"{branch_id}-draft", last + 2, branch_id, f"{branch_id}-head", False, True, False, False)], store.revision.schema)
    links = store.revision_table.filter(F.col("revision_id") == source)
    made = links.withColumn("revision_id", F.explode(F.array(F.lit(f"{branch_id}-head"), F.lit(f"{branch_id}-draft"))))
    return store.but(branch=store.branch.unionByName(branch), revision=store.revision.unionByName(revisions), revision_table=store.revision_table.unionByName(made))


def delete_branch(store: Store, branch_id: str) -> Store:
    """A branch without its revisions and links; not the root, and none that another branch starts from."""
    mine = store.revision.filter(F.col("branch_id") == branch_id).select("id")
    if not store.branch.filter((F.col("id") == branch_id) & F.col("is_root")).isEmpty():
        raise Refused("the root branch stays")
    if not store.revision.filter(F.col("branch_id") != branch_id).join(mine.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").isEmpty():
        raise Refused("another branch starts from it")
    return store.but(branch=store.branch.filter(F.col("id") != branch_id), revision=store.revision.filter(F.col("branch_id") != branch_id), revision_table=store.revision_table.join(mine.select(F.col("id").alias("revision_id")), "revision_id", "left_anti"))


def rename_cascade(rows: DataFrame, schema: dict, path: str | list[str], pairs: DataFrame) -> DataFrame:
    """id and new document of every row with a reference at a path ("*" for array elements) to a renamed target: pairs
    (old_id, new_id). Only the values at the path change; all else of the document stays."""
    named = references(rows, [steps(path)]).join(pairs.withColumnRenamed("old_id", "target"), "target")
    per = named.groupBy("version_id").agg(F.map_from_entries(F.collect_set(F.struct("target", "new_id"))).alias("to"))  # references of one row
    both = rows.join(per, "version_id")
    return both.select("id", rewritten("data", schema, path, lambda v: F.coalesce(F.element_at("to", v), v)).alias("data"))


def sweep(store: Store, protected: list[str] | None = None) -> Store:
    """Without tables that no revision links and then rows that no table links; shadow tables of running copies stay."""
    held = store.revision_table.select(F.col("table_version_id").alias("version_id")).distinct()
    tables = store.table_version.join(held.withColumn("h", F.lit(True)), "version_id", "left").filter(F.col("h") | F.col("version_id").isin(protected or [])).drop("h")
    links = store.row_table.join(tables.select(F.col("version_id").alias("table_version_id")), "table_version_id", "left_semi")
    return store.but(table_version=tables, row_table=links, row_version=store.row_version.join(links.select(F.col("row_version_id").alias("version_id")), "version_id", "left_semi"))


def next_migration_id(now: datetime, published: list[str], own: list[str]) -> str:
    """An ISO time not before now and later than every published id and own one: a millisecond later than an exact time, a
    second later than one written to the second, a day later than one that shows its day."""

    def past(text: str) -> datetime:
        read = lambda t: datetime.fromisoformat(t).replace(tzinfo=UTC)
        if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", text):
            return read(text[:-1]) + timedelta(milliseconds=1)
        if len(text) == DAY or text[DAY] == "t":
            return read(text[:DAY]) + timedelta(days=1)
        return read(text[:SECOND]) + timedelta(seconds=1)

    at = max([now.astimezone(UTC), *map(past, [*published, *own])])
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
