"""Filters over system columns and JSON paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.jsonpath import canonical, compile_where, remap, schema_type, value_at, values_at
from tessera.functions.names import valid_branch_name, valid_field_name, valid_row_id, valid_table_id
from tessera.operators import references, scan
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query, read, table_query
from tessera.sources.store import rows_of


def where(name: str, sql: str, tree: dict, version: str = "ot4"):
    @query(name, f"SELECT r.version_id FROM {ROWS} WHERE k.table_version_id = '{version}' AND ({sql})")
    def run(s, tree=tree, version=version):
        return rows_of(s, version).filter(compile_where(tree)).select("version_id")


STATUS, CENTS = "json_extract_string(r.data, '$.status')", "CAST(json_extract_string(r.data, '$.cents') AS DOUBLE)"
where("p1_boolean_tree", f"({STATUS} = 'O' OR {CENTS} > 30000000) AND NOT (r.id LIKE 'order-1%')", {"AND": [{"OR": [{"data": {"path": "status", "equals": "O"}}, {"data": {"path": "cents", "gt": 30000000}}]}, {"NOT": {"id": {"startsWith": "order-1"}}}]})
where("p2_system_columns", "r.readonly AND r.id LIKE '%-r' AND r.created_at >= 100 AND r.hash <> ''", {"readonly": {"equals": True}, "id": {"endsWith": "-r"}, "createdAt": {"gte": 100}, "hash": {"not": ""}})
where("p3_json_comparisons", f"{CENTS} >= 10000000 AND {CENTS} < 20000000 AND {STATUS} <> 'P'", {"AND": [{"data": {"path": "cents", "gte": 10000000, "lt": 20000000}}, {"NOT": [{"data": {"path": ["status"], "equals": "P"}}]}]})
where("p3b_nested_path", "CAST(json_extract_string(r.data, '$.props.k') AS DOUBLE) > 90", {"data": {"path": "props.k", "gt": 90}}, "et4")
where("p6_string_operations", "json_extract_string(r.data, '$.priority') LIKE '1-%' AND json_extract_string(r.data, '$.customer') LIKE '%7' AND json_extract_string(r.data, '$.customer') LIKE '%1%'", {"data": {"path": "priority", "string_starts_with": "1-"}, "AND": [{"data": {"path": "customer", "string_ends_with": "7", "string_contains": "1"}}]})
where("p7_in", "r.id IN ('order-6', 'order-7', 'order-13-r', 'order-none')", {"id": {"in": ["order-6", "order-7", "order-13-r", "order-none"]}})


@query("p8_system_remap", f"SELECT r.version_id FROM {ROWS} WHERE k.table_version_id = 'ot4' AND r.id LIKE '%99%' AND {STATUS} = 'F'")
def p8(s):
    schema = {"properties": {"rowId": {"$ref": "RowId"}, "status": {"type": "string"}}}
    tree = remap({"AND": [{"data": {"path": "rowId", "string_contains": "99"}}, {"data": {"path": "status", "equals": "F"}}]}, schema)
    return rows_of(s, "ot4").filter(compile_where(tree)).select("version_id")


DOCS = "(SELECT l_orderkey, '{\"items\":[' || string_agg('{\"part\":' || l_partkey || ',\"flag\":\"' || l_returnflag || '\",\"lines\":[{\"n\":' || l_linenumber || '}]}', ',' ORDER BY l_linenumber, l_partkey) || ']}' AS data FROM lineitem GROUP BY l_orderkey) AS d"


def item_documents(spark, sf_dir):
    """A document for each order with an array of its lines; only lines of one order are gathered."""
    li = read(spark, sf_dir, "lineitem")
    text = F.format_string('{"part":%d,"flag":"%s","lines":[{"n":%d}]}', "l_partkey", "l_returnflag", "l_linenumber")
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", text.alias("t"))))
    return li.groupBy("l_orderkey").agg(F.concat(F.lit('{"items":['), F.array_join(F.transform(lines, lambda x: x["t"]), ","), F.lit("]}")).alias("data"))


@table_query("p4_wildcard", f"SELECT l_orderkey FROM {DOCS} WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey > 1900)")
def p4(spark, sf_dir):
    return item_documents(spark, sf_dir).filter(compile_where({"data": {"path": ["items", "*", "part"], "gt": 1900}})).select("l_orderkey")


@table_query("p4b_nested_wildcard", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7")
def p4b(spark, sf_dir):
    return item_documents(spark, sf_dir).filter(compile_where({"data": {"path": "items[*].lines[*].n", "equals": 7}})).select("l_orderkey")


@table_query("p5_array_contains", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def p5(spark, sf_dir):
    docs = item_documents(spark, sf_dir).withColumn("data", F.to_json(F.struct(values_at("data", "items.*.flag").alias("flags"))))
    return docs.filter(compile_where({"data": {"path": "flags", "array_contains": ["A", "R"]}})).select("l_orderkey")


@query("p15_key_anywhere", f"SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'zs4' AND contains(r.data, '\"foreignKey\":\"nation\"')")
def p15(s):
    return references.key_anywhere(rows_of(s, "zs4"), "foreignKey", "nation").select("id")


@query("p16_any_path", f"SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ot4' AND (json_extract_string(r.data, '$.customer') = 'customer-3' OR {STATUS} = 'customer-3')")
def p16(s):
    return references.any_path_equals(rows_of(s, "ot4"), [["customer"], ["status"]], ["customer-3"]).select("id")


@query("p17_any_path_any_value", f"SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.customer') IN ('customer-3', 'customer-4') AND r.id <> 'order-6'")
def p17(s):
    return references.any_path_equals(rows_of(s, "ot4"), [["customer"]], ["customer-3", "customer-4"], ["order-6"]).select("id")


@query("p18_guards", "SELECT 'customer' AS key, true AS ok UNION ALL SELECT 'a\"b', false UNION ALL SELECT '$.x', true UNION ALL SELECT 'x.y', false")
def p18(s):
    def ok(guard, text):
        try:
            guard(text)
            return True
        except ValueError:
            return False

    rows = [(k, ok(references.guard_path if "." in k else references.guard_key, k)) for k in ("customer", 'a"b', "$.x", "x.y")]
    return s.branch.sparkSession.createDataFrame(rows, "key string, ok boolean")


@query("p19_null_safe_leaves", f"SELECT a.created_id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot2') a JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4') b USING (created_id) WHERE json_extract_string(a.data, '$.cents') IS DISTINCT FROM json_extract_string(b.data, '$.cents') OR json_extract_string(a.data, '$.none') IS DISTINCT FROM json_extract_string(b.data, '$.none')")
def p19(s):
    a, b = rows_of(s, "ot2").select("created_id", F.col("data").alias("a")), rows_of(s, "ot4").select("created_id", F.col("data").alias("b"))
    differs = ~value_at("a", "cents").eqNullSafe(value_at("b", "cents")) | ~value_at("a", "none").eqNullSafe(value_at("b", "none"))
    return a.join(b, "created_id").filter(differs).select("created_id")


@query("p20_names", "SELECT 'orders' AS name, true AS table_ok, true AS row_ok, true AS field_ok, true AS branch_ok UNION ALL SELECT 'my-row', true, true, false, true UNION ALL SELECT '1st', false, true, false, false UNION ALL SELECT '__x', false, false, false, false")
def p20(s):
    names = s.branch.sparkSession.createDataFrame([("orders",), ("my-row",), ("1st",), ("__x",)], "name string")
    n = F.col("name")
    return names.select("name", valid_table_id(n).alias("table_ok"), valid_row_id(n).alias("row_ok"), valid_field_name(n).alias("field_ok"), valid_branch_name(n).alias("branch_ok"))


@query("a5_count_filtered", f"SELECT count(*) AS total FROM {ROWS} WHERE k.table_version_id = 'ot4' AND {STATUS} = 'F'")
def a5(s):
    return scan.get_rows(s, "r5", "orders", 10, where={"data": {"path": "status", "equals": "F"}})[1]


@query("q1_get_rows", f"SELECT r.version_id, {CENTS} AS cents FROM {ROWS} WHERE k.table_version_id = 'ot4' AND {STATUS} = 'F' ORDER BY {CENTS} DESC NULLS FIRST, r.version_id DESC LIMIT 21")
def q1(s):
    page, _ = scan.get_rows(s, "r5", "orders", 20, where={"data": {"path": "status", "equals": "F"}}, order=[{"data": {"path": "cents", "type": "number", "order": "desc"}}])
    return page.rows.select("version_id", value_at("data", "cents").try_cast("double").alias("cents"))


@query("q1b_typed_rows", f"SELECT r.id, {CENTS} AS cents, {STATUS} AS status FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def q1b(s):
    schema = {"type": "object", "properties": {"cents": {"type": "number"}, "status": {"type": "string"}}}
    return rows_of(s, "ot4").select("id", F.from_json("data", schema_type(schema)).alias("d")).select("id", "d.cents", "d.status")


@query("f3_content_classes", f"SELECT count(DISTINCT r.hash) AS classes, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def f3(s):
    return rows_of(s, "ot4").select(F.sha2(canonical("data"), 256).alias("h")).agg(F.count_distinct("h").alias("classes"), F.count("*").alias("n"))
