"""Differences of two revisions: rows, tables, their statistics and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import Store, revision_rows, tables_of

SHOWN = ("id", "version_id", "hash", "data", "updated_at")


def linked_rows(store: Store, revision_id: str, table_created_id: str | None = None) -> DataFrame:
    """version_id and table_created_id of a revision's rows, from links alone."""
    tables = tables_of(store, revision_id).select(F.col("version_id").alias("table_version_id"), F.col("created_id").alias("table_created_id"))
    if table_created_id is not None:
        tables = tables.filter(F.col("table_created_id") == table_created_id)
    return store.row_table.join(F.broadcast(tables), "table_version_id").select(F.col("row_version_id").alias("version_id"), "table_created_id")  # one row a table


def classify(left_id: Column, right_id: Column, left_content: Column, right_content: Column) -> Column:
    """Kind of a change between two sides of one identity; null if there is none."""
    renamed, changed = ~left_id.eqNullSafe(right_id), ~left_content.eqNullSafe(right_content)
    return (
        F.when(left_id.isNull(), "ADDED").when(right_id.isNull(), "REMOVED").when(renamed & changed, "RENAMED_AND_MODIFIED").when(renamed, "RENAMED").when(changed, "MODIFIED")
    )


def row_pairs(store: Store, from_revision: str, to_revision: str, table_created_id: str | None = None, columns: tuple[str, ...] = SHOWN) -> DataFrame:
    """Both sides of every row whose version isn't shared, paired by identity: from_*, to_*, row_created_id.

    A version linked on both sides can't be a change, so links are compared first: one aggregate over the narrow links of
    both sides leaves the unshared versions with their side. Only these meet their payload, which is read once, and the
    two sides of an identity, which a revision holds once, come together by a second aggregate.
    """
    links = unshared_links(store, from_revision, to_revision, table_created_id)
    wanted = list(dict.fromkeys(("id", *columns)))
    rows = store.row_version.select("version_id", F.col("created_id").alias("row_created_id"), *[c for c in wanted if c != "version_id"]).join(links, "version_id")
    whole = F.struct(F.col("table_created_id"), *[F.col(c) for c in wanted])
    sides = {p: F.any_value(F.when(F.col("side") == n, whole), True).alias(p) for p, n in (("from", 1), ("to", 2))}
    both = rows.groupBy("row_created_id").agg(*sides.values())
    out = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in sides for c in wanted]
    return both.select("row_created_id", *out, F.coalesce("to.table_created_id", "from.table_created_id").alias("table_created_id"))


def unshared_links(store: Store, from_revision: str, to_revision: str, table_created_id: str | None = None) -> DataFrame:
    """version_id, side (1: from, 2: to) and table_created_id of the row versions that one of the revisions links alone."""
    both = linked_rows(store, from_revision, table_created_id).withColumn("side", F.lit(1)).unionByName(linked_rows(store, to_revision, table_created_id).withColumn("side", F.lit(2)))
    return both.groupBy("version_id").agg(F.bit_or("side").alias("side"), F.max("table_created_id").alias("table_created_id")).filter("side < 3")


def with_documents(pairs: DataFrame, store: Store) -> DataFrame:
    """Narrow pairs with the documents of both sides."""
    left = store.row_version.select(F.col("version_id").alias("from_version_id"), F.col("data").alias("from_data"))
    right = store.row_version.select(F.col("version_id").alias("to_version_id"), F.col("data").alias("to_data"))
    return pairs.join(left, "from_version_id", "left").join(right, "to_version_id", "left")


def row_changes(store: Store, from_revision: str, to_revision: str, table_created_id: str | None = None, search: str | None = None, kinds: list[str] | None = None, columns: tuple[str, ...] = SHOWN) -> DataFrame:
    """Changed rows of the two revisions, compared by id and content hash. Versions of equal content are no change.

    search is a case-insensitive substring of either id in which % and _ are wildcards. Asking for renamed or modified
    rows includes those that are both.
    """
    rows = row_pairs(store, from_revision, to_revision, table_created_id, tuple(dict.fromkeys((*columns, "hash", "updated_at"))))
    rows = rows.withColumn("change_type", classify(F.col("from_id"), F.col("to_id"), F.col("from_hash"), F.col("to_hash"))).filter("change_type is not null")
    if search is not None:
        pattern = f"%{search}%"
        rows = rows.filter(F.coalesce(F.col("from_id").ilike(pattern), F.lit(False)) | F.coalesce(F.col("to_id").ilike(pattern), F.lit(False)))
    if kinds:
        wide = set(kinds) | ({"RENAMED_AND_MODIFIED"} if {"RENAMED", "MODIFIED"} & set(kinds) else set())
        rows = rows.filter(F.col("change_type").isin(sorted(wide)))
    return rows


ROW_ORDER = lambda: [F.coalesce("to_updated_at", "from_updated_at").desc(), F.col("row_created_id").asc()]


def page_with_payload(changes: DataFrame, store: Store, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of narrow changes, then the documents of its rows only. Pages far down are better read by keyset
    (`paging.keyset_page`), as an offset sorts all before it."""
    return with_documents(changes.orderBy(*order).offset(offset).limit(limit), store)


def change_counts(changes: DataFrame, kind: str = "change_type") -> DataFrame:
    """total, added, removed, renamed, modified; a row that is both counts in both parts."""
    k = F.upper(kind)
    return changes.agg(
        F.count("*").alias("total"), F.count_if(k == "ADDED").alias("added"), F.count_if(k == "REMOVED").alias("removed"),
        F.count_if(k.isin("RENAMED", "RENAMED_AND_MODIFIED")).alias("renamed"), F.count_if(k.isin("MODIFIED", "RENAMED_AND_MODIFIED")).alias("modified"),
    )


def table_changes(store: Store, from_revision: str, to_revision: str, kinds: list[str] | None = None, system: bool | None = False) -> DataFrame:
    """Changed tables, compared by id and version; kinds in lower case, and filters by them are exact."""
    a, b = tables_of(store, from_revision, system), tables_of(store, to_revision, system)
    side = lambda t, p: t.select("created_id", F.col("id").alias(f"{p}_id"), F.col("version_id").alias(f"{p}_version_id"))
    both = side(a, "from").join(side(b, "to"), "created_id", "full")
    both = both.withColumn("change_type", F.lower(classify(F.col("from_id"), F.col("to_id"), F.col("from_version_id"), F.col("to_version_id")))).filter("change_type is not null")
    return both.filter(F.col("change_type").isin([k.lower() for k in kinds])) if kinds else both


def has_row_diffs(store: Store, from_revision: str, to_revision: str, table_created_id: str) -> DataFrame:
    """One row: whether any row version is linked on one side only, be its content equal or not."""
    a, b = linked_rows(store, from_revision, table_created_id), linked_rows(store, to_revision, table_created_id)
    only = a.join(b, "version_id", "left_anti").unionByName(b.join(a, "version_id", "left_anti"))
    return only.limit(1).agg((F.count("*") > 0).alias("has_diffs"))


def has_table_diffs(store: Store, from_revision: str, to_revision: str) -> DataFrame:
    """One row: the same for table versions, system tables included."""
    return table_changes(store, from_revision, to_revision, system=None).limit(1).agg((F.count("*") > 0).alias("has_diffs"))


def revision_changes(store: Store, revision_id: str, compare_with: str | None = None) -> DataFrame:
    """One row: counts of changed tables and rows against another revision, by default the parent; none without one."""
    if compare_with is None:
        parent = store.revision.filter(F.col("id") == revision_id).select("parent_id").first()
        if parent is None or parent[0] is None:
            return change_counts(store.revision.limit(0).select(F.lit("").alias("change_type"))).select(*[F.lit(0).cast("long").alias(c) for c in ("total_changes", "tables_total", "rows_total")])
        compare_with = parent[0]
    tables = change_counts(table_changes(store, compare_with, revision_id)).select(*[F.col(c).alias(f"tables_{c}") for c in ("total", "added", "removed", "renamed", "modified")])
    rows = change_counts(row_changes(store, compare_with, revision_id, columns=())).select(*[F.col(c).alias(f"rows_{c}") for c in ("total", "added", "removed", "renamed", "modified")])
    return tables.crossJoin(rows).withColumn("total_changes", F.col("tables_total") + F.col("rows_total"))  # one row each


def view_changes(store: Store, from_revision: str, to_revision: str) -> DataFrame:
    """table_id, id and kind (added, removed, renamed, modified) of saved views that differ, and whether the view is, or
    was, the default of a table whose default changes."""

    def views(revision: str, p: str) -> DataFrame:
        rows = revision_rows(store, revision, True).filter("table_id = 'sys_views'").select(F.col("id").alias("table_id"), "data")
        each = F.explode(F.from_json(F.get_json_object("data", "$.views"), "array<struct<id:string,name:string,whole:string>>"))
        whole = F.explode(F.from_json(F.get_json_object("data", "$.views"), "array<string>"))
        config = rows.select("table_id", whole.alias("w")).select("table_id", F.get_json_object("w", "$.id").alias("id"), F.to_json(F.from_json("w", "struct<columns:variant,filters:variant,sorts:variant,search:variant,description:variant>")).alias(f"{p}_config"))
        named = rows.select("table_id", F.get_json_object("data", "$.defaultViewId").alias("default"), each.alias("v")).select("table_id", "v.id", F.col("v.name").alias(f"{p}_name"), (F.col("v.id") == F.col("default")).alias(f"{p}_default"))
        return named.join(config, ["table_id", "id"])

    both = views(from_revision, "a").join(views(to_revision, "b"), ["table_id", "id"], "full")
    kind = F.when(F.col("a_name").isNull(), "added").when(F.col("b_name").isNull(), "removed").when(F.col("a_name") != F.col("b_name"), "renamed").when(F.col("a_config") != F.col("b_config"), "modified")
    moved = F.coalesce("a_default", F.lit(False)) != F.coalesce("b_default", F.lit(False))
    return both.select("table_id", "id", kind.alias("kind"), moved.alias("default_changed")).filter("kind is not null or default_changed")


def table_change_details(store: Store, from_revision: str, to_revision: str) -> DataFrame:
    """Changed tables with their changed rows, the ledger entries about them that are new, and their changed views."""
    tables = table_changes(store, from_revision, to_revision)
    rows = row_changes(store, from_revision, to_revision, columns=()).groupBy(F.col("table_created_id").alias("created_id")).agg(F.count("*").alias("n_rows"))
    ledger = lambda r: revision_rows(store, r, True).filter("table_id = 'sys_migrations'")
    new = ledger(to_revision).join(ledger(from_revision).select("id"), "id", "left_anti").select(F.get_json_object("data", "$.tableId").alias("name"))
    new = new.groupBy("name").agg(F.count("*").alias("n"))
    seen = view_changes(store, from_revision, to_revision).groupBy(F.col("table_id").alias("name")).agg(F.count("kind").alias("n"))

    def by_name(counts: DataFrame, c: str) -> DataFrame:
        named = tables.select("created_id", F.explode(F.array_distinct(F.array_compact(F.array("from_id", "to_id")))).alias("name"))
        return named.join(counts, "name").groupBy("created_id").agg(F.sum("n").alias(c))

    out = tables.join(rows, "created_id", "left").join(by_name(new, "n_entries"), "created_id", "left").join(by_name(seen, "n_views"), "created_id", "left")
    return out.fillna(0, ["n_rows", "n_entries", "n_views"])


def field_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each changed field of rows with from_data and to_data, by dotted paths."""
    sides = lambda f: (F.get_json_object("from_data", f"$.{f}"), F.get_json_object("to_data", f"$.{f}"))
    each = F.array(*[F.struct(F.lit(f).alias("field_path"), sides(f)[0].alias("old_value"), sides(f)[1].alias("new_value")) for f in fields])
    x = changes.withColumn("f", F.explode(F.filter(each, lambda v: ~v["old_value"].eqNullSafe(v["new_value"]))))
    kind = F.when(F.col("f.old_value").isNull(), "FIELD_ADDED").when(F.col("f.new_value").isNull(), "FIELD_REMOVED").otherwise("FIELD_MODIFIED")
    return x.select("row_created_id", "f.*", kind.alias("field_change"))


def content_diffs(store: Store, from_table: str, to_table: str, compared: tuple[str, ...] = ("id", "hash", "schema_hash", "published_at", "meta")) -> DataFrame:
    """Unshared rows of two table versions that differ in a compared column, null-safe."""
    links = lambda tv: store.row_table.filter(F.col("table_version_id") == tv).select(F.col("row_version_id").alias("version_id"))
    a, b = links(from_table), links(to_table)
    side = lambda x, y, p: store.row_version.join(x.join(y, "version_id", "left_anti"), "version_id").select("created_id", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in compared])
    both = side(a, b, "from").join(side(b, a, "to"), "created_id", "full")
    differs = F.col("from_here").isNull() | F.col("to_here").isNull()
    for c in compared:
        differs = differs | ~F.col(f"from_{c}").eqNullSafe(F.col(f"to_{c}"))
    return both.filter(differs)
