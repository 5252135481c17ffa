"""File usage: blobs by content hash, references from rows, bytes by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import Store


def storage_bytes(store: Store, projects: list[str] | None = None) -> DataFrame:
    """Counted bytes by project; with a list, also those that have none."""
    used = store.project_file_usage
    if projects is None:
        return used.select("project_id", "file_bytes")
    wanted = used.sparkSession.createDataFrame([(p,) for p in projects], "project_id string")
    return wanted.join(used, "project_id", "left").select("project_id", F.coalesce("file_bytes", F.lit(0)).alias("file_bytes"))


def validate_bytes(store: Store) -> DataFrame:
    """project_id, expected bytes and count of active blobs, counted bytes and their drift, links."""
    active = store.file_blob.filter("deleted_at is null").groupBy("project_id").agg(F.sum("size").alias("expected"), F.count("*").alias("blobs"))
    links = store.file_blob_row.join(store.file_blob.select(F.col("id").alias("blob_id"), "project_id"), "blob_id").groupBy("project_id").agg(F.count("*").alias("links"))
    out = active.join(store.project_file_usage, "project_id", "full").join(links, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("project_id", zero("expected"), zero("blobs"), zero("file_bytes"), zero("links")).withColumn("drift", F.col("expected") - F.col("file_bytes"))


def pending_deletions(store: Store, after_hash: str | None = None, limit: int = 1000) -> DataFrame:
    """Hashes that are tombstoned and active nowhere, in order."""
    dead = store.file_blob.filter("deleted_at is not null").select("hash").distinct()
    dead = dead.join(store.file_blob.filter("deleted_at is null").select("hash"), "hash", "left_anti")
    if after_hash is not None:
        dead = dead.filter(F.col("hash") > after_hash)
    return dead.orderBy("hash").limit(limit)


def orphan_blobs(store: Store) -> DataFrame:
    """Active blobs that no row holds."""
    return store.file_blob.filter("deleted_at is null").join(store.file_blob_row.select(F.col("blob_id").alias("id")), "id", "left_anti")


def tombstone(store: Store, at: int) -> tuple[DataFrame, DataFrame]:
    """Blobs after orphans are tombstoned, and usage less the freed bytes, never below zero."""
    gone = orphan_blobs(store).select("id", F.lit(True).alias("gone"))
    blobs = store.file_blob.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("gone"), F.lit(at)).otherwise(F.col("deleted_at"))).drop("gone")
    freed = orphan_blobs(store).groupBy("project_id").agg(F.sum("size").alias("freed"))
    usage = store.project_file_usage.join(freed, "project_id", "left")
    return blobs, usage.select("project_id", F.greatest(F.lit(0), F.col("file_bytes") - F.coalesce("freed", F.lit(0))).alias("file_bytes"), F.coalesce("freed", F.lit(0)).alias("freed"))


def references(rows: DataFrame, file: str = "file") -> DataFrame:
    """Uploaded files with a hash, once for each row and hash; sizes below zero count as zero."""
    f = F.col(file)
    kept = rows.filter((f["status"] == "uploaded") & (f["hash"] != ""))
    return kept.select("row_version_id", "project_id", f["hash"].alias("hash"), F.greatest(F.lit(0), f["size"]).cast("long").alias("size")).dropDuplicates(["row_version_id", "hash"])


def register(store: Store, refs: DataFrame) -> DataFrame:
    """What registering references does to each blob: insert, reactivate or keep, and the bytes that it adds."""
    new = refs.groupBy("project_id", "hash").agg(F.min("size").alias("new_size"), F.count("*").alias("links"))
    have = store.file_blob.select("project_id", "hash", "size", "deleted_at", F.lit(True).alias("here"))
    out = new.join(have, ["project_id", "hash"], "left")
    action = F.when(F.col("here").isNull(), "insert").when(F.col("deleted_at").isNotNull(), "reactivate").otherwise("keep")
    return out.select("project_id", "hash", "links", action.alias("action"), F.when(action == "insert", F.col("new_size")).when(action == "reactivate", F.col("size")).otherwise(0).alias("added_bytes"))


def backfill(refs: DataFrame) -> DataFrame:
    """One row: distinct rows, hashes and bytes of a scan of all revisions."""
    by_hash = refs.groupBy("project_id", "hash").agg(F.min("size").alias("size"), F.count_distinct("row_version_id").alias("n"))
    return by_hash.groupBy("project_id").agg(F.count("*").alias("blobs"), F.sum("n").alias("links"), F.sum("size").alias("bytes"))
