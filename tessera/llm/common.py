"""What the text operators share: the shared folder, written tables, words, prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Bytes of text that numpy code takes at a time; its arrays are a few dozen times that.
CHUNK_BYTES = 1 << 20
#: A word, as a pattern for Java's and RE2's engines.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark removes a written plan's shuffle files itself where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set and Spark is local (tests), one on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


class Work:
    """Tables that one operator run writes to the shared folder, so that a lost executor costs no recomputation.

    A written table no longer needs the shuffle files of its plan, so Spark is told to remove them with the write. A
    result may read these tables as long as the session lives; the run's folder is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.hadoop = spark._jsc.hadoopConfiguration()
        self.path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.hadoop).delete(at, True)
        except (Py4JError, OSError):  # the driver's JVM has gone before its folder
            pass


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string array without copying, and where each value begins and ends; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of that column; a longer row stands alone."""
    _, at = views(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_PLACES = multipliers(1 << 16, 5)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of each value: the distinct words, the index of each word, and where each value's words begin and end."""
    if pa.types.is_binary(column.type):
        column = column.view(pa.string())
    parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, ends = parts.flatten(), parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


def word_places(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and where each value's words begin and end."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    full = ~_BLANK[buf]
    begins = full.copy()
    begins[1:] &= ~full[:-1] | edge[1:n]
    closes = full
    closes[:-1] &= ~full[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


def hash_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (bytes times odd numbers by place, mixed), and where each value's words begin and end."""
    starts, stops, ends = word_places(buf, at)
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    length = stops - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    by = _PLACES[place & 0xFFFF]
    if len(place) > 0xFFFF:
        by = by + (place >> 16).astype(np.uint64)
    value = (buf[place + np.repeat(starts, length)].astype(np.uint64) + np.uint64(1)) * by
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), ends


def owners(ends: np.ndarray) -> np.ndarray:
    """For each element, which value it belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def prefix_sums(work: Work, df: DataFrame, order: list[str], size: str, within: str | None = None) -> DataFrame:
    """df with `before` (sum of `size` over earlier rows in the order) and `rank` (their number), of the same `within`.

    Rows are dealt by ranges of the order, summed inside each partition, and shifted by what earlier partitions hold in
    total. Only those totals, one row a partition (and value of `within`), are put together. If given, `within` must
    come first in `order`.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    schema = StructType([*df.schema.fields, StructField("part", IntegerType()), StructField("before", LongType()), StructField("rank", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, group, total, count = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            sizes = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            ends = np.cumsum(sizes)
            if within is None:
                before, rank = total + ends - sizes, count + np.arange(len(sizes))
                total, count = total + int(ends[-1]), count + len(sizes)
            else:
                g = b.column(within).to_numpy(zero_copy_only=False)
                new = np.concatenate([[g[0] != group], g[1:] != g[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
                base = np.where(first >= 0, (ends - sizes)[first], -total)
                row = np.where(first >= 0, first, -count)
                before, rank = ends - sizes - base, np.arange(len(g)) - row
                group, total, count = g[-1], int(before[-1] + sizes[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(rank)], names=[*b.schema.names, "part", "before", "rank"])

    dealt = df.repartitionByRange(tasks_for(df.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = work.write(dealt.mapInArrow(run, schema), "prefix")
    group = [within] if within else []
    totals = rows.groupBy("part", *group).agg(F.sum(size).alias("s"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("part", *group, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    shift = shift if within else F.broadcast(shift)  # one row a partition
    return rows.join(shift, ["part", *group]).withColumns({"before": F.col("before") + F.col("s0"), "rank": F.col("rank") + F.col("n0")}).drop("part", "s0", "n0")


def byte_length(c: Column | str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
