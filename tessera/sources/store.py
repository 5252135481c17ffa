"""The version store: its tables, how they are read and written, and snapshots of a revision."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import graph

ROW_COLUMNS = ("version_id", "created_id", "id", "readonly", "data", "meta", "hash", "schema_hash", "created_at", "updated_at", "published_at")


@dataclass(frozen=True)
class Store:
    """Links stay apart from payload, so that a revision is read by its links alone."""

    branch: DataFrame
    revision: DataFrame
    table_version: DataFrame
    row_version: DataFrame
    revision_table: DataFrame
    row_table: DataFrame
    schema_fk: DataFrame
    file_blob: DataFrame
    file_blob_row: DataFrame
    project_file_usage: DataFrame

    def but(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)


def read(spark: SparkSession, path: str) -> Store:
    """A store written by `write`."""
    return Store(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Store)})


def write(store: Store, path: str, mode: str = "errorifexists") -> None:
    """Every table as Parquet; links are clustered by table version, so that a table's rows are read by pruning."""
    for f in fields(Store):
        df = getattr(store, f.name)
        if f.name == "row_table":
            df = df.repartitionByRange("table_version_id").sortWithinPartitions("table_version_id", "row_version_id")
        df.write.mode(mode).parquet(f"{path}/{f.name}")


#: Names a folder with a written store; without it, the graph of the fixed tables is built as it is read.
STORE_DIR = "tessera.store.dir"


def opened(spark: SparkSession, sf_dir: str) -> Store:
    """The written store that the session names, or else the graph over a folder of the fixed tables."""
    path = spark.conf.get(STORE_DIR, None)
    return read(spark, path) if path else fixture(spark, sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; where none is set and Spark is local (tests), one on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fixture(spark: SparkSession, sf_dir: str) -> Store:
    """The graph of `tessera.sources.graph`, lazily, over a folder of the fixed tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "part", "supplier", "events", "documents")}

    def run(name: str) -> DataFrame:
        text = graph.sql_for("spark", graph.GRAPH[name])
        used = {t: df for t, df in tables.items() if f"FROM {t}" in text}
        text = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(text, **used)

    return Store(**{name: run(name) for name in graph.GRAPH})


def tables_of(store: Store, revision_id: str, system: bool | None = False) -> DataFrame:
    """Table versions of a revision."""
    links = store.revision_table.filter(F.col("revision_id") == revision_id).select(F.col("table_version_id").alias("version_id"))
    found = store.table_version.join(links, "version_id")
    return found if system is None else found.filter(F.col("system") == system)


def links_of(store: Store, table_version: str | Column) -> DataFrame:
    """Row versions linked to one table version."""
    return store.row_table.filter(F.col("table_version_id") == table_version).select(F.col("row_version_id").alias("version_id"))


def table_at(store: Store, revision_id: str, table_id: str) -> str | None:
    """Version of a table in a revision, by its name there."""
    row = tables_of(store, revision_id, None).filter(F.col("id") == table_id).select("version_id").first()
    return row[0] if row else None


def rows_of(store: Store, table_version: str) -> DataFrame:
    return store.row_version.join(links_of(store, table_version), "version_id").select(*ROW_COLUMNS)


#: Links that one task sorts or groups: ids compress so well that tasks dealt by bytes would hold millions.
TASK_LINKS = 1 << 18


def parts_for(links: DataFrame) -> int:
    """Into how many parts links are dealt: by their number, so that a task's memory doesn't grow with the tables."""
    return max(1, -(-links.count() // TASK_LINKS))


def dealt(links: DataFrame, parts: int, key: str) -> DataFrame:
    return links.repartition(parts, key)


def system_links(store: Store, revision_id: str) -> list:
    """Links of a revision's system tables, each with its table: brought to the driver, as they are a few for each table."""
    tables = {r["version_id"]: r for r in tables_of(store, revision_id, True).select("version_id", "created_id", "id").collect()}
    links = store.row_table.filter(F.col("table_version_id").isin(list(tables))).select("row_version_id", "table_version_id").collect() if tables else []
    return [(r["row_version_id"], r["table_version_id"], tables[r["table_version_id"]]["created_id"], tables[r["table_version_id"]]["id"]) for r in links]


def system_rows(store: Store, revision_id: str) -> DataFrame:
    """`revision_rows` of the system tables: their versions are named in the plan, so that no other row is joined or sent."""
    links = system_links(store, revision_id)
    rows = store.row_version.filter(F.col("version_id").isin(sorted({r[0] for r in links})))
    held = store.branch.sparkSession.createDataFrame(links, "version_id string, table_version_id string, table_created_id string, table_id string")
    return rows.join(F.broadcast(held), "version_id").select(*ROW_COLUMNS, "table_version_id", "table_created_id", "table_id")  # a few for each table


def revision_rows(store: Store, revision_id: str, system: bool | None = False) -> DataFrame:
    """All rows of a revision with the table that holds them."""
    tables = tables_of(store, revision_id, system).select(F.col("version_id").alias("table_version_id"), F.col("created_id").alias("table_created_id"), F.col("id").alias("table_id"))
    links = store.row_table.join(tables, "table_version_id").withColumnRenamed("row_version_id", "version_id")
    return store.row_version.join(links, "version_id").select(*ROW_COLUMNS, "table_version_id", "table_created_id", "table_id")
