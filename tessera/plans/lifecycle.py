"""Tables of drafts through their life, plugins on pages, file rules, and resumable copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import files, plugins
from tessera.functions.jsonpath import schema_type
from tessera.operators import scan, tables
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query, read, table_query
from tessera.sources.store import rows_of, scratch, system_rows, table_at, tables_of

NOW = 1704300000000
ENTRY = "'2024-01-03T16:40:00.000Z'"


def parts(s, revision):
    """Names and system rows of a revision: part, id, detail."""
    named = tables_of(s, revision, None).select(F.lit("table").alias("part"), "id", F.lit("").alias("detail"))
    at = lambda p: F.get_json_object("data", f"$.{p}")
    entry = F.concat_ws(" ", at("changeType"), at("tableId"), at("nextTableId"))
    detail = F.when(F.col("table_id") == "sys_schemas", F.col("data")).when(F.col("table_id") == "sys_migrations", entry).otherwise(F.get_json_object("data", "$.defaultViewId"))
    return named.unionByName(system_rows(s, revision).select(F.col("table_id").alias("part"), "id", detail.alias("detail")))


OLD_ENTRIES = "SELECT 'sys_migrations', r.id, concat_ws(' ', json_extract_string(r.data, '$.changeType'), json_extract_string(r.data, '$.tableId'), json_extract_string(r.data, '$.nextTableId')) FROM " + ROWS + " WHERE k.table_version_id = "
OLD_VIEWS = "SELECT 'sys_views', r.id, json_extract_string(r.data, '$.defaultViewId') FROM " + ROWS + " WHERE k.table_version_id = "
OLD_SCHEMAS = "SELECT 'sys_schemas', r.id, r.data FROM " + ROWS + " WHERE k.table_version_id = "
OLD_TABLES = "SELECT 'table' AS part, t.id, '' AS detail FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = "


@query("v10_rename_table", f"SELECT 'table' AS part, CASE t.id WHEN 'customer' THEN 'buyers' ELSE t.id END AS id, '' AS detail FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'f9' UNION ALL SELECT 'sys_schemas', CASE r.id WHEN 'customer' THEN 'buyers' ELSE r.id END, replace(r.data, '\"foreignKey\":\"customer\"', '\"foreignKey\":\"buyers\"') FROM {ROWS} WHERE k.table_version_id = 'zs1' UNION ALL {OLD_VIEWS}'zv1' UNION ALL {OLD_ENTRIES}'zm1' UNION ALL SELECT 'sys_migrations', {ENTRY}, 'rename customer buyers'")
def v10(s):
    """The schema's row follows the name, as do foreign keys of other schemas; the ledger gets one entry."""
    return parts(tables.rename_table(s, "f9", "customer", "buyers", NOW), "f9")


@query("v10b_rename_with_views", f"SELECT 'table' AS part, CASE t.id WHEN 'orders' THEN 'sales' ELSE t.id END AS id, '' AS detail FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'f9' UNION ALL SELECT 'sys_schemas', CASE r.id WHEN 'orders' THEN 'sales' ELSE r.id END, r.data FROM {ROWS} WHERE k.table_version_id = 'zs1' UNION ALL SELECT 'sys_views', 'sales', json_extract_string(r.data, '$.defaultViewId') FROM {ROWS} WHERE k.table_version_id = 'zv1' UNION ALL {OLD_ENTRIES}'zm1' UNION ALL SELECT 'sys_migrations', {ENTRY}, 'rename orders sales'")
def v10b(s):
    return parts(tables.rename_table(s, "f9", "orders", "sales", NOW), "f9")


NOTES = {"type": "object", "properties": {"text": {"type": "string", "default": ""}, "order": {"type": "string", "default": "", "foreignKey": "orders"}}}


@query("v4b_create_table", f"{OLD_TABLES}'f9' UNION ALL SELECT 'table', 'notes', '' UNION ALL {OLD_SCHEMAS}'zs1' UNION ALL SELECT 'sys_schemas', 'notes', '{tables.text_of(NOTES)}' UNION ALL {OLD_VIEWS}'zv1' UNION ALL {OLD_ENTRIES}'zm1' UNION ALL SELECT 'sys_migrations', {ENTRY}, 'init notes'")
def v4b(s):
    return parts(tables.create_table(s, "f9", "notes", NOTES, NOW), "f9")


ADDED = [{"op": "add", "path": "/properties/note", "value": {"type": "string", "default": ""}}]
AFTER = "replace(r.data, '}}}}}}', '}},\"note\":{{\"type\":\"string\",\"default\":\"\"}}}}}}')".replace("{{", "{").replace("}}", "}")


@query("v20_schema_history", f"SELECT r.id, {AFTER} AS data, 1 AS n_changes, md5({AFTER}) AS hash, 'add' AS op FROM {ROWS} WHERE k.table_version_id = 'zs4' AND r.id = 'orders'")
def v20(s):
    """The schema's row after an update, with the change in its history."""
    after = tables.update_schema(s, "r6", "orders", ADDED, NOW)
    row = rows_of(after, table_at(after, "r6", "sys_schemas")).filter("id = 'orders'")
    changes = F.from_json("meta", "array<struct<patches:array<struct<op:string>>,hash:string>>")
    return row.select("id", "data", F.size(changes).alias("n_changes"), changes[0]["hash"].alias("hash"), changes[0]["patches"][0]["op"].alias("op"))


@query("v12b_table_update_ledger", f"{OLD_TABLES}'r6' UNION ALL SELECT 'sys_schemas', r.id, CASE r.id WHEN 'orders' THEN {AFTER} ELSE r.data END FROM {ROWS} WHERE k.table_version_id = 'zs4' UNION ALL {OLD_VIEWS}'zv4' UNION ALL {OLD_ENTRIES}'zm4' UNION ALL SELECT 'sys_migrations', '2024-02-02T00:00:00.001Z', 'update orders'")
def v12b(s):
    """What a whole table's update leaves in the system tables."""
    return parts(tables.update_table(s, "r6", "orders", ADDED, NOW), "r6")


@query("v12c_table_update_rows", f"SELECT r.created_id, json_extract_string(r.data, '$.status') AS status, 'fresh' AS note FROM {ROWS} WHERE k.table_version_id = 'ot6'")
def v12c(s):
    """The same update's rows, with a plugin's part in it: what is computed after the migration."""
    filled = lambda rows: rows.withColumn("d", F.col("d").withField("note", F.lit("fresh")))
    after = tables.update_table(s, "r6", "orders", ADDED, NOW, filled)
    at = lambda p: F.get_json_object("data", f"$.{p}")
    return rows_of(after, table_at(after, "r6", "orders")).select("created_id", at("status").alias("status"), at("note").alias("note"))


@query("v23_system_table", f"{OLD_TABLES}'f9' AND t.id <> 'sys_views' UNION ALL SELECT 'table', 'sys_views', '' UNION ALL {OLD_SCHEMAS}'zs1' UNION ALL SELECT 'sys_views', 'customer', 'v1' UNION ALL {OLD_ENTRIES}'zm1'")
def v23(s):
    """A views document saved in a draft that has no table for it."""
    without = s.but(revision_table=s.revision_table.filter("not (revision_id = 'f9' and table_version_id = 'zv1')"))
    schema, _ = tables.schema_of(without, "f9", "customer")
    document = {"version": 1, "defaultViewId": "v1", "views": [{"id": "v1", "name": "All", "columns": [{"field": "data.name"}]}]}
    return parts(tables.put_views(without, "f9", "customer", document, schema, NOW), "f9")


COMPUTED = {"type": "object", "properties": {
    "cents": {"type": "number"}, "status": {"type": "string"}, "key": {"type": "string", "$ref": "RowId"}, "who": {"type": "string", "$ref": "RowCreatedId"}, "made": {"type": "string", "$ref": "RowCreatedAt"},
    "double": {"type": "number", "default": 0, "x-formula": {"version": 1, "expression": "cents * 2"}}, "more": {"type": "number", "default": 0, "x-formula": "double + 1"},
}}
CENTS = "CAST(json_extract_string(r.data, '$.cents') AS DOUBLE)"


@query("f1_computed_page", f"SELECT r.id AS key, r.created_id AS who, r.created_at AS made, {CENTS} * 2 AS double, {CENTS} * 2 + 1 AS more, 0 AS errors FROM {ROWS} WHERE k.table_version_id = 'ot4' ORDER BY {CENTS} DESC NULLS FIRST, r.version_id DESC LIMIT 31")
def f1(s):
    """A page of rows with everything computed on it; only the page's documents are."""
    page, _ = scan.get_rows(s, "r5", "orders", 30, order=[{"data": {"path": "cents", "type": "number", "order": "desc"}}], schema=COMPUTED, plugins=plugins.standard("https://files.example/"))
    made = F.unix_millis(F.to_timestamp("d.made", "yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    return page.rows.select("d.key", "d.who", made.alias("made"), "d.double", "d.more", F.size("formula_errors").alias("errors"))


@query("f1b_written_row", f"SELECT r.id, '' AS key, 0.0::DOUBLE AS double, {CENTS} AS cents FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def f1b(s):
    """What is computed isn't stored: a written row has defaults in its place."""
    sent = rows_of(s, "ot4").select("id", F.from_json("data", schema_type(COMPUTED)).alias("d")).withColumn("d", F.col("d").withField("key", F.lit("sent")).withField("double", F.lit(5.0)))
    return plugins.run("after_create", plugins.standard(), sent, "d", COMPUTED).select("id", "d.key", "d.double", "d.cents")


FILE = schema_type({"$ref": "File"})


def file_values(spark, sf_dir):
    """A File for each document, with a fault by its number."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.col("n_chars").cast("double").alias("n"))
    k = F.col("doc_id") % 10
    when = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    return d.select("doc_id", F.struct(
        when(1, F.lit("lost"), F.lit("uploaded")).alias("status"), when(2, F.lit("short"), F.left("h", F.lit(21))).alias("fileId"), when(3, F.lit("no address"), F.lit("")).alias("url"), when(4, F.lit("a/b.png"), F.lit("a.png")).alias("fileName"), when(5, F.lit("XYZ"), F.col("h")).alias("hash"),
        when(6, F.lit("p.n"), F.lit("png")).alias("extension"), when(7, F.lit("image"), F.lit("image/png")).alias("mimeType"), when(8, F.col("n") + 0.5, F.col("n") + 1).alias("size"), when(9, F.lit(-1.0), F.lit(10.0)).alias("width"), F.lit(10.0).alias("height"),
    ).alias("file"))


@table_query("f8_restore_rules", "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'status' WHEN 2 THEN 'fileId' WHEN 3 THEN 'url' WHEN 4 THEN 'fileName' WHEN 5 THEN 'hash' WHEN 6 THEN 'extension' WHEN 7 THEN 'mimeType,dimensions' WHEN 8 THEN 'size' ELSE 'width' END AS problems FROM documents")
def f8(spark, sf_dir):
    rows = file_values(spark, sf_dir)
    return rows.select("doc_id", F.array_join(files.restore_problems(F.col("file"), F.array("file.fileId")), ",").alias("problems"))


@table_query("f8b_update_rules", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'hash' WHEN 2 THEN 'no such file' ELSE 'width,height' END AS problems FROM documents WHERE doc_id % 10 = 0")
def f8b(spark, sf_dir):
    """A file keeps all but its name and address."""
    rows = file_values(spark, sf_dir).filter("doc_id % 10 = 0")
    f, k = F.col("file"), F.col("doc_id") % 4
    named = f.withField("fileName", F.lit("other.png"))
    new = F.when(k == 1, named.withField("hash", F.lit("0"))).when(k == 2, named.withField("fileId", F.lit("x"))).when(k == 3, named.withField("width", F.lit(1.0)).withField("height", F.lit(2.0))).otherwise(named)
    return rows.select("doc_id", F.array_join(files.update_problems(new, F.array(f)), ",").alias("problems"))


@table_query("v22_upload", "SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'b.txt' WHEN doc_id % 10 = 4 THEN 'a/b.png' ELSE 'a.png' END AS name, CASE WHEN doc_id % 10 = 2 THEN 5.0 WHEN doc_id % 10 = 8 THEN n_chars + 0.5 ELSE n_chars + 1 END::DOUBLE AS size FROM documents")
def v22(spark, sf_dir):
    made = files.uploaded(F.col("file"), "short", "b.txt", "text/plain", "00", 5)
    return file_values(spark, sf_dir).select("doc_id", made.alias("f")).select("doc_id", F.col("f.fileName").alias("name"), F.col("f.size").alias("size"))


@table_query("t1_resumable_copy", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders WHERE o_orderkey % 3 <> 0")
def t1(spark, sf_dir):
    """A table's files through a transform, run twice: the second run finds nothing left to do."""
    from tessera.streaming.copy import copy_rows

    folder = scratch(spark, "copy")
    for _ in range(2):
        copy_rows(spark, sf_dir, f"{folder}/rows", f"{folder}/checkpoint", lambda d: d.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey", "o_custkey * 2 as twice"), pattern="orders.parquet")
    return spark.read.parquet(f"{folder}/rows")
