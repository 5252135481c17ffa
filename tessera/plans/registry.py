"""Registration of queries with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import store as stores
from tessera.sources.graph import with_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[stores.Store], DataFrame]], Callable]:
    """Registers f(store) under a name; sql may name the graph's tables and the fixed tables."""

    def put(f: Callable[[stores.Store], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(stores.opened(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_graph(sql)
        return f

    return put


def table_query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers f(spark, sf_dir), which reads the fixed tables itself."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_graph(sql)
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
