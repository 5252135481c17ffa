"""Scans, lookups, joins over links, references and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paging
from tessera.functions.jsonpath import compile_order, sort_columns
from tessera.operators import history, references, scan
from tessera.plans.registry import query
from tessera.sources.store import links_of, revision_rows, rows_of, tables_of

IN_REVISION = "SELECT t.* FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = "
ROWS = "row_version r JOIN row_table k ON k.row_version_id = r.version_id"


@query("s1_table_rows", f"SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def s1(s):
    return rows_of(s, "ot4")


@query("s2_resolve_table", IN_REVISION + "'r4' AND t.id = 'clients'")
def s2(s):
    return tables_of(s, "r4").filter("id = 'clients'")


REVISION_ROWS = f"SELECT r.version_id, r.id, t.id AS table_id FROM {ROWS} JOIN table_version t ON t.version_id = k.table_version_id JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'r5' AND NOT t.system"


@query("s3_revision_rows", REVISION_ROWS)
def s3(s):
    return revision_rows(s, "r5").select("version_id", "id", "table_id")


@query("s4_list_tables", IN_REVISION + "'r5' AND NOT t.system ORDER BY t.created_at DESC, t.version_id LIMIT 2 OFFSET 1")
def s4(s):
    return paging.offset_page(scan.list_tables(s, "r5"), [F.col("created_at").desc(), F.col("version_id")], 2, "1")


@query("s5_revision_tables", IN_REVISION + "'f8' AND NOT t.system")
def s5(s):
    return scan.list_tables(s, "f8")


@query("s6_get_row", f"SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4' AND r.id = 'order-24-r'")
def s6(s):
    return scan.row_by_id(s, "r5", "orders", "order-24-r")


@query("s7_table_schema", f"SELECT r.id, r.data FROM {ROWS} WHERE k.table_version_id = 'zs4' AND r.id = 'orders'")
def s7(s):
    return scan.row_by_id(s, "r5", "sys_schemas", "orders").select("id", "data")


@query("s8_count_rows", "SELECT count(*) AS n_rows FROM row_table WHERE table_version_id = 'ot6'")
def s8(s):
    return scan.count_rows(s, "ot6")


@query("s9_branch_heads", "SELECT b.*, max(CASE WHEN is_start THEN r.id END) AS start_id, max(CASE WHEN is_head THEN r.id END) AS head_id, max(CASE WHEN is_draft THEN r.id END) AS draft_id, bool_or(is_draft AND has_changes) AS touched FROM branch b LEFT JOIN revision r ON r.branch_id = b.id WHERE b.project_id = 'p1' GROUP BY ALL")
def s9(s):
    return scan.branch_heads(s, "p1")


@query("s9b_get_revision", "SELECT * FROM revision WHERE id = 'r4'")
def s9b(s):
    return s.revision.filter("id = 'r4'")


@query("s10_migrations", f"SELECT r.id, r.data FROM {ROWS} WHERE k.table_version_id = 'zm4'")
def s10(s):
    return scan.migrations(s, "r5").select("id", "data")


@query("s11_table_views", f"SELECT coalesce(max(r.data), '') AS views FROM {ROWS} WHERE k.table_version_id = 'zv4' AND r.id = 'orders'")
def s11(s):
    return scan.table_views(s, "r5", "orders")


@query("s11b_default_views", f"SELECT '{scan.DEFAULT_VIEWS}' AS views")
def s11b(s):
    return scan.table_views(s, "r5", "clients")


@query("s13_insert_rows", "SELECT count(*) + (SELECT count(*) FROM row_version WHERE version_id LIKE 'p%') AS n, count(*) AS old FROM row_table")
def s13(s):
    after = scan.insert_rows(s, s.row_version.filter(F.col("version_id").startswith("p")), "ot6")
    return after.row_table.agg(F.count("*").alias("n")).crossJoin(s.row_table.agg(F.count("*").alias("old")))


@query("s14_copy_links", "SELECT row_version_id, 'ot9' AS table_version_id FROM row_table WHERE table_version_id = 'ot4' AND row_version_id NOT IN (SELECT row_version_id FROM row_table WHERE table_version_id = 'ot2') UNION ALL SELECT row_version_id, 'ot9' FROM row_table WHERE table_version_id = 'st1'")
def s14(s):
    return scan.copied_links(s, "ot4", "ot9", links_of(s, "ot2"), links_of(s, "st1"))


@query("l1_default_order", f"SELECT r.version_id, r.created_at FROM {ROWS} WHERE k.table_version_id = 'ot4' ORDER BY r.created_at DESC, r.version_id DESC LIMIT 50")
def l1(s):
    return rows_of(s, "ot4").orderBy(*sort_columns(compile_order(None))).limit(50).select("version_id", "created_at")


@query("l2_json_sort", f"SELECT r.version_id FROM {ROWS} WHERE k.table_version_id = 'ot4' ORDER BY CAST(json_extract_string(data, '$.cents') AS DOUBLE) DESC NULLS FIRST, json_extract_string(data, '$.status') ASC NULLS LAST, r.version_id DESC LIMIT 100")
def l2(s):
    order = [{"data": {"path": "cents", "type": "number", "order": "desc"}}, {"data": {"path": "status", "order": "asc"}}]
    return rows_of(s, "ot4").orderBy(*sort_columns(compile_order(order))).limit(100).select("version_id")


@query("l3_keyset_page", f"SELECT r.version_id FROM {ROWS} WHERE k.table_version_id = 'et4' AND (json_extract_string(data, '$.type') > 'click' OR (json_extract_string(data, '$.type') = 'click' AND r.version_id < 'e500')) ORDER BY json_extract_string(data, '$.type'), r.version_id DESC LIMIT 101")
def l3(s):
    order = [{"data": {"path": "type"}}]
    cursor = paging.encode_cursor(["click", "e500"], order)
    return paging.keyset_page(rows_of(s, "et4"), compile_order(order), 100, paging.decode_cursor(cursor, order)).rows.select("version_id")


@query("l4_offset_page", f"SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ct4' ORDER BY r.id LIMIT 25 OFFSET 30")
def l4(s):
    return paging.offset_page(rows_of(s, "ct4").select("id"), [F.col("id")], 25, "30")


@query("l5_revision_page", "SELECT id, sequence FROM revision WHERE branch_id = 'b1' AND sequence < 5 ORDER BY sequence DESC LIMIT 2")
def l5(s):
    return paging.revision_page(s.revision.filter("branch_id = 'b1'"), 2, before=5).select("id", "sequence")


@query("l8_with_ties", f"SELECT id FROM (SELECT r.id, rank() OVER (ORDER BY json_extract_string(data, '$.type')) AS n FROM {ROWS} WHERE k.table_version_id = 'et4') AS x WHERE n <= 10")
def l8(s):
    return paging.with_ties(rows_of(s, "et4").withColumn("type", F.get_json_object("data", "$.type")), F.col("type"), 10).select("id")


@query("l10_byte_order", f"SELECT id, row_number() OVER (ORDER BY id, version_id) AS n FROM (SELECT DISTINCT r.id, r.version_id FROM {ROWS} WHERE k.table_version_id = 'ct4') AS x ORDER BY n LIMIT 40")
def l10(s):
    top = rows_of(s, "ct4").select("id", "version_id").orderBy("id", "version_id").limit(40)
    return top.select("id", F.row_number().over(Window.orderBy("id", "version_id")).cast("long").alias("n"))  # 40 rows


@query("l12_history_page", "WITH v AS (SELECT DISTINCT r.version_id, r.created_at, CAST(split_part(r.version_id, '-', 2) AS INT) AS seq FROM row_version r WHERE r.created_id = 'c3') SELECT version_id, seq AS introduced_seq FROM v WHERE seq IN (1, 2)")
def l12(s):
    return history.previous_states(s, "r5", "to", "c3", after=4, first=10).select("version_id", "introduced_seq")


@query("l12b_history_cursor", "WITH v AS (SELECT DISTINCT r.version_id, CAST(split_part(r.version_id, '-', 2) AS INT) AS seq FROM row_version r WHERE r.created_id = 'c73'), e AS (SELECT * FROM v WHERE seq < 5) SELECT version_id, seq AS introduced_seq FROM e ORDER BY seq DESC LIMIT 1 OFFSET 2")
def l12b(s):
    """The second page of one earlier state, by the cursor of the first."""
    first = history.row_page(s, "r5", "to", "c73", 1).select("cursor").first()
    return history.row_page(s, "r5", "to", "c73", 1, first["cursor"]).select("version_id", "introduced_seq")


@query("j7_as_of_revision", "SELECT b.branch_id, a.at, (SELECT id FROM revision r WHERE r.branch_id = b.branch_id AND r.sequence <= a.at ORDER BY r.sequence DESC LIMIT 1) AS found_id FROM (SELECT DISTINCT branch_id FROM revision) b CROSS JOIN (SELECT CAST(unnest(range(1, 12)) AS INT) AS at) a WHERE EXISTS (SELECT 1 FROM revision r WHERE r.branch_id = b.branch_id AND r.sequence <= a.at)")
def j7(s):
    points = s.revision.select("branch_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(i) for i in range(1, 12)])))
    return history.floor_revision(s, points)


@query("j8_previous_end", "SELECT id, lag(sequence) OVER (PARTITION BY branch_id ORDER BY sequence) AS before FROM revision")
def j8(s):
    return s.revision.select("id", F.lag("sequence").over(Window.partitionBy("branch_id").orderBy("sequence")).alias("before"))


@query("j12_lineage", "WITH RECURSIVE line AS (SELECT branch_id, sequence AS max_seq, 0 AS depth FROM revision WHERE id = 'f8' UNION ALL SELECT p.branch_id, p.sequence, l.depth + 1 FROM line l JOIN revision s ON s.branch_id = l.branch_id AND s.is_start JOIN revision p ON p.id = s.parent_id) SELECT * FROM line")
def j12(s):
    return history.lineage(s, "f8")


@query("j9_lineage_revisions", "SELECT id FROM revision WHERE (branch_id = 'b2' AND sequence <= 8) OR (branch_id = 'b1' AND sequence <= 3)")
def j9(s):
    return s.revision.join(history.lineage(s, "f8"), "branch_id").filter("sequence <= max_seq").select("id")


def orders(s, version="ot4"):
    return rows_of(s, version)


@query("j13_follow_renames", f"SELECT DISTINCT id FROM (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ot2' UNION SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ot4' AND r.version_id LIKE '%-4' AND r.id LIKE '%-r') AS x")
def j13(s):
    pairs = references.renames(orders(s, "ot2"), orders(s, "ot4"))
    return references.follow_renames(orders(s, "ot2").select("id"), pairs, 3)


@query("j14_renames", f"SELECT a.created_id, a.id AS old_id, b.id AS new_id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot2') a JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4') b USING (created_id) WHERE a.id <> b.id")
def j14(s):
    return references.renames(orders(s, "ot2"), orders(s, "ot4"))


@query("j15_other_side", f"SELECT b.version_id, a.id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot2') a JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4') b USING (created_id)")
def j15(s):
    return orders(s, "ot2").select("created_id", "id").join(orders(s).select("created_id", "version_id"), "created_id").select("version_id", "id")


@query("j16_references_to", f"SELECT c.version_id, c.id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ct4') c WHERE c.id IN (SELECT json_extract_string(r.data, '$.customer') FROM {ROWS} WHERE k.table_version_id = 'ot4' AND r.id = 'order-8')")
def j16(s):
    return references.referred_rows(orders(s), "order-8", [["customer"]], rows_of(s, "ct4")).select("version_id", "id")


@query("j17_references_by", f"SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.customer') = 'customer-7'")
def j17(s):
    return references.referring_rows(orders(s), [["customer"]], "customer-7").select("id")


@query("j18_reference_counts", f"SELECT json_extract_string(r.data, '$.customer') AS target, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot4' GROUP BY 1")
def j18(s):
    return references.reference_counts(orders(s), [["customer"]])


@query("j19_table_references", "SELECT f.* FROM schema_fk f WHERE table_id IN (SELECT t.id FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'r5') AND target_id IN (SELECT t.id FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'r5')")
def j19(s):
    return references.table_references(s, "r5")


DANGLING = f"SELECT json_extract_string(r.data, '$.customer') AS target, min(r.id) AS first_row, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.customer') NOT IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ct4') GROUP BY 1"


@query("j20_dangling_references", DANGLING)
def j20(s):
    return references.dangling(orders(s), [["customer"]], rows_of(s, "ct4"))


@query("j21_first_referrer", f"SELECT json_extract_string(r.data, '$.customer') AS target, min(r.id) AS first_row FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.customer') IN (SELECT a.id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ct1') a JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ct4') b USING (created_id) WHERE a.id <> b.id) GROUP BY 1")
def j21(s):
    lost = references.renames(rows_of(s, "ct1"), rows_of(s, "ct4")).select(F.col("old_id").alias("target"))
    return references.references(orders(s), [["customer"]]).join(lost, "target", "left_semi").groupBy("target").agg(F.min("id").alias("first_row"))


@query("j22_unresolved_references", f"SELECT x.target, min(x.id) AS first_row FROM (SELECT r.id, json_extract_string(r.data, '$.customer') AS target FROM {ROWS} WHERE k.table_version_id = 'ot4') x WHERE target NOT IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ct4') OR target IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'ct4' AND r.version_id LIKE '%-4') GROUP BY 1")
def j22(s):
    changed = rows_of(s, "ct4").filter(F.col("version_id").endswith("-4"))
    return references.unresolved(orders(s), [["customer"]], rows_of(s, "ct4"), changed)


@query("j23_child_branches", "SELECT b.id, b.name, r.id AS start_id FROM branch b JOIN revision r ON r.branch_id = b.id WHERE r.is_start AND r.parent_id = 'r3'")
def j23(s):
    return scan.child_branches(s, "r3").select("id", "name", "start_id")


@query("j23b_parent_branches", "SELECT b.id, r.parent_id AS from_revision, p.branch_id AS from_branch FROM branch b JOIN revision r ON r.branch_id = b.id AND r.is_start LEFT JOIN revision p ON p.id = r.parent_id")
def j23b(s):
    return scan.parent_branches(s).select("id", "from_revision", "from_branch")


@query("j24_parent_and_children", "SELECT p.id, c.id AS child_id FROM revision p JOIN revision c ON c.parent_id = p.id")
def j24(s):
    return s.revision.select("id").join(s.revision.select(F.col("parent_id").alias("id"), F.col("id").alias("child_id")), "id")


@query("j5_orphans", "SELECT version_id AS id, 'table' AS kind FROM table_version WHERE version_id NOT IN (SELECT table_version_id FROM revision_table) UNION ALL SELECT version_id, 'row' FROM row_version WHERE version_id NOT IN (SELECT row_version_id FROM row_table)")
def j5(s):
    tables = s.table_version.join(s.revision_table.select(F.col("table_version_id").alias("version_id")), "version_id", "left_anti").select(F.col("version_id").alias("id"), F.lit("table").alias("kind"))
    rows = s.row_version.join(s.row_table.select(F.col("row_version_id").alias("version_id")), "version_id", "left_anti").select(F.col("version_id").alias("id"), F.lit("row").alias("kind"))
    return tables.unionByName(rows)
