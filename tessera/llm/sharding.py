"""Contiguous shards of nearly equal bytes, cut by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Work, byte_length, prefix_sums, tasks_for

SHARDS = 40
ROW_BYTES = 16


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, row_bytes: int = ROW_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Shard and slot of every row: rows in the order of their id are cut where the running size passes k / n of the total.

    A row goes where the middle of its bytes falls, so a shard's size differs from the target by one row at most (and a
    row larger than the target may leave its neighbours empty). Shards are contiguous in the order (id, crc, size), nulls
    first; rows that agree in all three are interchangeable. A null text has no bytes and the checksum 0. An empty table
    gives no rows. With `keep`, these columns stand as the struct `own` beside the result; others are ignored. Rows that
    repeat, and rows without an id, each get a slot. Texts may be of any length.

    Only the size totals of each range partition and the first row number of each shard are put together.
    """
    work = Work(docs.sparkSession, "shards")
    text = F.col(text_col).cast("binary")
    own = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own")] if keep else []
    rows = docs.select(
        *own, F.col(id_col).alias("doc_id"), (byte_length(text) + F.lit(row_bytes)).alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32")
    )
    placed = prefix_sums(work, rows, ["doc_id", "text_crc32", "size"], "size")
    total = docs.sparkSession.read.parquet(f"{work.path}/prefix").agg(F.sum("size").alias("t")).first()["t"] or 1
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(30,0)") * F.lit(n_shards)
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(30,0)")), F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # at most n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["own"] if keep else [])
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Each row of `docs` with its shard and slot, as Parquet folders `shard=k` of files sorted by slot. A shard is written
    by as many tasks as its share of the rows asks for. Columns named shard or slot are replaced."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = assign_shards(docs, keep=keep, **options).select("own.*", "shard", "slot")
    placed.repartitionByRange(tasks_for(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
