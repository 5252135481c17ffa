"""Resumable copies of a table's rows through a transform, and their state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STATES = ("PENDING", "COPYING", "SWAPPING", "COMPLETED", "FAILED", "CANCELLED")
MOVES = {"PENDING": {"COPYING", "CANCELLED", "FAILED"}, "COPYING": {"SWAPPING", "CANCELLED", "FAILED"}, "SWAPPING": {"COMPLETED", "FAILED"}}
ACTIVE = ("PENDING", "COPYING", "SWAPPING")


def move(state: str, to: str) -> str:
    """The next state of a copy; what isn't a step of the machine is refused, as is giving up while swapping."""
    if to not in MOVES.get(state, set()):
        raise ValueError(f"{state} doesn't go to {to}")
    return to


def copy_rows(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 8, pattern: str = "*.parquet") -> None:
    """Every file of a Parquet folder through a transform into another, in batches that resume where the last run ended."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(source)
    out = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out.start(target).awaitTermination()
