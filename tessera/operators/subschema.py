"""Occurrences of a shared schema in rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import ref_paths, schema_type


def items(rows: DataFrame, schema: dict, ref: str, table_id: str) -> DataFrame:
    """One row for each value whose schema refers to `ref`: table_id, row_id, version_id, row_created_at, field_path, data.

    Documents are read once with a type; each path is unfolded by array positions, and the paths are united.
    """
    typed = rows.select(F.lit(table_id).alias("table_id"), F.col("id").alias("row_id"), "version_id", F.col("created_at").alias("row_created_at"), F.from_json("data", schema_type(schema)).alias("d"))
    keep = ["table_id", "row_id", "version_id", "row_created_at"]

    def unfold(path: list[str]) -> DataFrame:
        df = typed.select(*keep, F.lit("").alias("field_path"), F.col("d").alias("data"))
        for step in path:
            if step == "*":
                df = df.select(*keep, "field_path", F.posexplode("data").alias("i", "data"))
                df = df.select(*keep, F.concat("field_path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("field_path"), "data")
            else:
                dot = F.when(F.col("field_path") == "", F.lit("")).otherwise(F.lit("."))
                df = df.select(*keep, F.concat("field_path", dot, F.lit(step)).alias("field_path"), F.col("data")[step].alias("data"))
        return df.filter("data is not null")

    return reduce(DataFrame.unionByName, [unfold(p) for p in ref_paths(schema, ref)])
