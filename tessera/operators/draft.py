"""A branch's draft against its head: pairs of unshared rows, kinds, replaced rows, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paging import with_ties
from tessera.operators.diff import row_pairs
from tessera.sources.store import Store

COLUMNS = ("id", "version_id", "hash", "schema_hash", "published_at", "meta", "updated_at", "data")
#: What kinds, counts and pages need; documents are joined to what is left (`diff.with_documents`).
NARROW = ("id", "version_id", "hash", "published_at", "meta", "updated_at")


def reported_pairs(store: Store, head: str, draft: str, table_created_id: str | None = None, columns: tuple[str, ...] = COLUMNS, marked: bool = True) -> DataFrame:
    """Pairs of unshared rows with `change_type` by effective content, `one_sided` and, if `marked`, `replaced`.

    Content is the hash first and then publishedAt and meta; the schema's hash is no content. Two one-sided pairs of one
    table and id are a replaced row; only one-sided pairs are grouped to find them.
    """
    rows = row_pairs(store, head, draft, table_created_id, columns)
    same = F.col("from_hash").eqNullSafe(F.col("to_hash")) & F.col("from_published_at").eqNullSafe(F.col("to_published_at")) & F.col("from_meta").eqNullSafe(F.col("to_meta"))
    renamed = F.col("from_id") != F.col("to_id")
    kind = F.when(F.col("from_id").isNull(), "ADDED").when(F.col("to_id").isNull(), "REMOVED").when(renamed & ~same, "RENAMED_AND_MODIFIED").when(renamed, "RENAMED").when(~same, "MODIFIED")
    rows = rows.withColumns({"change_type": kind, "one_sided": F.col("from_id").isNull() | F.col("to_id").isNull(), "row_id": F.coalesce("to_id", "from_id")}).filter("change_type is not null")
    if not marked:
        return rows
    twice = rows.filter("one_sided").groupBy("table_created_id", "row_id").agg(F.count("*").alias("n"), F.max(F.coalesce("to_updated_at", "from_updated_at")).alias("replaced_at")).filter("n = 2")
    rows = rows.join(twice.select("table_created_id", "row_id", "replaced_at", F.lit(True).alias("r")), ["table_created_id", "row_id"], "left")
    return rows.withColumn("replaced", F.coalesce(F.col("r") & F.col("one_sided"), F.lit(False))).drop("r")


def kind_matches(kinds: list[str]) -> Column:
    """Replaced rows match REPLACED alone; renamed or modified rows include those that are both."""
    wide = set(kinds) | ({"RENAMED_AND_MODIFIED"} if {"RENAMED", "MODIFIED"} & set(kinds) else set())
    return F.when(F.col("replaced"), F.lit("REPLACED" in kinds)).otherwise(F.col("change_type").isin(sorted(wide)))


def search_matches(term: str) -> Column:
    """A plain case-insensitive substring of either id; no wildcards."""
    t = F.lit(term.lower())
    return F.coalesce(F.contains(F.lower("to_id"), t), F.lit(False)) | F.coalesce(F.contains(F.lower("from_id"), t), F.lit(False))


def row_id_matches(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """Pairs with one of the draft ids, or of a renamed row whose head id no draft row holds now."""
    held = pairs.filter("to_id is not null").select("table_created_id", F.col("to_id").alias("from_id"), F.lit(True).alias("held")).distinct()
    marked = pairs.join(held, ["table_created_id", "from_id"], "left")
    return marked.filter(F.col("row_id").isin(ids) | (F.col("from_id").isin(ids) & F.col("held").isNull())).drop("held")


def row_counts(pairs: DataFrame) -> DataFrame:
    """For each table: total, added, removed, replaced, renamed, modified; a replaced row is one row."""
    one_sided = F.count_if("one_sided")
    replaced = one_sided - F.count_distinct(F.when(F.col("one_sided"), F.col("row_id")))
    k = F.col("change_type")
    return pairs.groupBy("table_created_id").agg(
        (F.count("*") - replaced).alias("total"), (F.count_if(k == "ADDED") - replaced).alias("added"), (F.count_if(k == "REMOVED") - replaced).alias("removed"),
        replaced.alias("replaced"), F.count_if(k.isin("RENAMED", "RENAMED_AND_MODIFIED")).alias("renamed"), F.count_if(k.isin("MODIFIED", "RENAMED_AND_MODIFIED")).alias("modified"),
    )


def unit_counts(units: DataFrame) -> DataFrame:
    """For each table: how many rows have units of their own, and whether any has."""
    per = units.groupBy("table_created_id").agg(F.count_distinct("row").alias("rows_with_units"))
    return per.withColumn("has_row_units", F.col("rows_with_units") > 0)


def recent_order() -> list[Column]:
    """Rows with a time newest first, removed rows last, ties by the id's bytes."""
    at = F.when(F.col("replaced"), F.col("replaced_at")).otherwise(F.col("to_updated_at"))
    return [at.isNull().asc(), at.desc_nulls_last(), F.col("row_id").asc(), F.col("row_created_id").asc()]


def page_by_ids(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs of the first n ids, whole: what ties with the last id comes too."""
    return with_ties(pairs, F.col("row_id"), n)


def companions(pairs: DataFrame, page: DataFrame) -> DataFrame:
    """Pairs outside a page at the page's ids."""
    return pairs.join(page.select("table_created_id", "row_id").distinct(), ["table_created_id", "row_id"], "left_semi").join(page.select("row_created_id"), "row_created_id", "left_anti")


def field_value(rows: DataFrame, path: str, start: int, length: int) -> DataFrame:
    """A slice of a text value, its length in UTF-16 units, its JSON size in bytes and a content token."""
    v = F.get_json_object("data", f"$.{path}")
    wide = F.length(F.encode(v, "UTF-16BE")) / 2
    raw = F.decode(F.substring(F.encode(v, "UTF-16BE"), 2 * start + 1, 2 * length), "UTF-16BE")
    return rows.select("id", raw.alias("slice"), wide.cast("long").alias("units"), F.octet_length(F.to_json(F.struct(v.alias("v")))).cast("long").alias("json_bytes"), token(v).alias("token"))


def token(value: Column) -> Column:
    """SHA-256 in the URL-safe alphabet without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(value, 256))), "+/", "-_"), F.lit("="))


def cut_bytes(value: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many bytes of UTF-8."""
    short = F.octet_length(value) <= most
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.aggregate(F.slice(chars, 1, most), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, c: F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), F.when(a["bytes"] + F.octet_length(c) <= most, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
    return F.when(short, value).otherwise(F.substring(value, F.lit(1), n))
