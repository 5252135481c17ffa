"""Foreign keys between rows and between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import values_at
from tessera.sources.store import Store, tables_of


def guard_key(key: str) -> str:
    """A JSON key that may be searched for."""
    if not key or len(key) > 1000 or any(c in key for c in "\0\"'\\"):
        raise ValueError(f"bad key {key!r}")
    return key


def guard_path(path: str) -> str:
    if not path.startswith("$") or len(path) > 1000 or "\0" in path:
        raise ValueError(f"bad path {path!r}")
    return path


def references(rows: DataFrame, paths: list[list[str]]) -> DataFrame:
    """One row for each foreign key value: version_id, id, target."""
    found = F.concat(*[values_at("data", p) for p in paths])
    return rows.select("version_id", F.col("id"), F.explode(F.filter(F.array_distinct(found), lambda x: x != "")).alias("target"))


def referred_rows(rows: DataFrame, row_id: str, paths: list[list[str]], targets: DataFrame) -> DataFrame:
    """Rows of another table that a row's foreign keys name."""
    wanted = references(rows.filter(F.col("id") == row_id), paths).select(F.col("target").alias("id"))
    return targets.join(wanted, "id", "left_semi")


def referring_rows(rows: DataFrame, paths: list[list[str]], row_id: str) -> DataFrame:
    """Rows whose foreign keys hold an id: a predicate, no join."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.array_contains(values_at("data", p), row_id)
    return rows.filter(hit)


def any_path_equals(rows: DataFrame, paths: list[list[str]], values: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Rows with any of the values at any of the paths, but for some ids."""
    found = F.arrays_overlap(F.concat(*[values_at("data", p) for p in paths]), F.array(*map(F.lit, values)))
    return rows.filter(found & ~F.col("id").isin(excluded or []))


def key_anywhere(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose document holds key = value (a text) at any depth, by the document's own text.

    In canonical JSON a text member reads "key":"value"; the same characters inside a text would have their quotes
    escaped, so the search is exact.
    """
    from tessera.functions.jsonpath import canonical

    member = F.regexp_replace(F.to_json(F.create_map(F.lit(guard_key(key)), F.lit(value))), r"^\{|\}$", "")
    text = canonical("data")
    plain = F.contains(text, F.concat(F.lit("{"), member)) | F.contains(text, F.concat(F.lit(","), member))
    return rows.filter(plain)


def reference_counts(rows: DataFrame, paths: list[list[str]]) -> DataFrame:
    """How many references each id gets."""
    return references(rows, paths).groupBy("target").agg(F.count("*").alias("n"))


def table_references(store: Store, revision_id: str) -> DataFrame:
    """Edges between tables of a revision: table_id, target_id, path."""
    names = tables_of(store, revision_id).select("id")
    return store.schema_fk.join(names.withColumnRenamed("id", "table_id"), "table_id").join(names.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def dangling(rows: DataFrame, paths: list[list[str]], targets: DataFrame) -> DataFrame:
    """Foreign key values that no row of the target has, with the first row that holds each."""
    missing = references(rows, paths).join(targets.select(F.col("id").alias("target")), "target", "left_anti")
    return missing.groupBy("target").agg(F.min("id").alias("first_row"), F.count("*").alias("n"))


def unresolved(rows: DataFrame, paths: list[list[str]], targets: DataFrame, changed: DataFrame) -> DataFrame:
    """Foreign key values that a changed row had or no row has, with the first row that holds each."""
    held = targets.select(F.col("id").alias("target"), F.lit(True).alias("here")).distinct()
    lost = changed.select(F.col("id").alias("target"), F.lit(True).alias("lost")).distinct()
    r = references(rows, paths).join(held, "target", "left").join(lost, "target", "left")
    return r.filter("lost or here is null").groupBy("target").agg(F.min("id").alias("first_row"))


def renames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two sides with one identity and different ids."""
    a = left.select("created_id", F.col("id").alias("old_id"))
    return a.join(right.select("created_id", F.col("id").alias("new_id")), "created_id").filter("old_id <> new_id")


def follow_renames(start: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """Ids reached from `id` through old_id -> new_id in at most so many steps."""
    seen = start.select("id").distinct()
    edge = seen
    for _ in range(hops):
        edge = edge.join(pairs.select(F.col("old_id").alias("id"), "new_id"), "id").select(F.col("new_id").alias("id")).distinct()
        seen = seen.unionByName(edge).distinct()
    return seen
