"""Write transitions and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import draft, versioning
from tessera.operators.references import renames
from tessera.plans import planner
from tessera.plans.changes import DRAFT, FIELDS, SIDE, pairs_sql
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query, read, table_query
from tessera.sources.store import rows_of, tables_of


@query("v1_touch_table", "SELECT 'links' AS k, count(*) AS n FROM row_table WHERE table_version_id = 'ct4' UNION ALL SELECT 'revisions', 2")
def v1(s):
    after = versioning.touch_table(s, "r6", "ct4", "ct6")
    a = after.row_table.filter("table_version_id = 'ct6'").agg(F.lit("links").alias("k"), F.count("*").alias("n"))
    return a.unionByName(after.revision_table.filter("table_version_id = 'ct4'").agg(F.lit("revisions").alias("k"), F.count("*").alias("n")))


@query("v2_touch_rows", f"SELECT r.created_id, r.version_id || '+' AS version_id, r.hash FROM {ROWS} WHERE k.table_version_id = 'ot6' AND r.readonly AND r.id IN ('order-7', 'order-5', 'order-8')")
def v2(s):
    ids = s.branch.sparkSession.createDataFrame([("order-7",), ("order-5",), ("order-8",)], "id string")
    return versioning.touched_rows(s, "ot6", ids, F.concat("version_id", F.lit("+"))).select("created_id", "version_id", "hash")


ORDERS = {"type": "object", "properties": {k: {"type": "number" if k == "cents" else "string"} for k in FIELDS}}


def closed(s, data="'{\"closed\":true}'"):
    return versioning.update_rows(s, "ot6", rows_of(s, "ot6").filter("created_at % 3 = 0").select("id", F.expr(data).alias("data")), 77)


@query("v3_update_rows", f"SELECT r.created_id, CASE WHEN r.created_at % 3 = 0 THEN r.version_id || CASE WHEN r.readonly THEN '@77' ELSE '' END ELSE r.version_id END AS version_id, CASE WHEN r.created_at % 3 = 0 THEN '{{\"closed\":true}}' ELSE r.data END AS data FROM {ROWS} WHERE k.table_version_id = 'ot6'")
def v3(s):
    return rows_of(closed(s), "ot6").select("created_id", "version_id", "data")


@query("v3b_remove_rows", f"SELECT r.version_id FROM {ROWS} WHERE k.table_version_id = 'ot6' AND r.created_at % 4 <> 1")
def v3b(s):
    return rows_of(versioning.remove_rows(s, "ot6", rows_of(s, "ot6").filter("created_at % 4 = 1").select("id")), "ot6").select("version_id")


@query("v3c_rename_rows", f"SELECT r.created_id, r.id || CASE WHEN r.created_at % 6 = 0 THEN '-new' ELSE '' END AS id FROM {ROWS} WHERE k.table_version_id = 'ot6'")
def v3c(s):
    pairs = rows_of(s, "ot6").filter("created_at % 6 = 0").select(F.col("id").alias("old_id"), F.concat("id", F.lit("-new")).alias("new_id")).distinct()
    return rows_of(versioning.rename_rows(s, "ot6", pairs, 78), "ot6").select("created_id", "id")


@query("v4_remove_table", "SELECT (SELECT count(*) FROM row_version) - (SELECT count(*) FROM row_version WHERE version_id IN (SELECT row_version_id FROM row_table GROUP BY 1 HAVING count(*) = 1 AND max(table_version_id) = 'ot6')) AS n_rows, 6 AS n_tables")
def v4(s):
    after = versioning.remove_table(s, "r6", "ot6")
    return after.row_version.agg(F.count("*").alias("n_rows")).crossJoin(tables_of(after, "r6", None).agg(F.count("*").cast("int").alias("n_tables")))


@query("v5_commit", "SELECT id, is_head, is_draft FROM revision WHERE branch_id = 'b2' OR sequence < 5 UNION ALL SELECT 'r5', false, false UNION ALL SELECT 'r6', true, false UNION ALL SELECT 'r10', false, true")
def v5(s):
    return versioning.commit(s, "b1", "r10").revision.select("id", "is_head", "is_draft")


@query("v5b_commit_locks", "SELECT count(*) AS n FROM row_version WHERE false")
def v5b(s):
    after = versioning.commit(s, "b1", "r10")
    return rows_of(after, "ot6").filter("not readonly").agg(F.count("*").alias("n"))


@query("v6_revert", "SELECT table_version_id FROM revision_table WHERE revision_id = 'r5'")
def v6(s):
    return versioning.revert(s, "r5", "r6").revision_table.filter("revision_id = 'r6'").select("table_version_id")


@query("v7_recompute_has_changes", "SELECT 'touched only' AS k, false AS has_changes UNION ALL SELECT 'draft', true")
def v7(s):
    clean = versioning.touch_table(versioning.revert(s, "r5", "r6"), "r6", "ct4", "ct6")
    rows = [("touched only", versioning.recompute_has_changes(clean, "r5", "r6")[1]), ("draft", versioning.recompute_has_changes(s, "r5", "r6")[1])]
    return s.branch.sparkSession.createDataFrame(rows, "k string, has_changes boolean")


@query("v8_create_branch", "SELECT 'b3-head' AS revision_id, table_version_id FROM revision_table WHERE revision_id = 'r4' UNION ALL SELECT 'b3-draft', table_version_id FROM revision_table WHERE revision_id = 'r4'")
def v8(s):
    after = versioning.create_branch(s, "b3", "third", "p1", "r4")
    return after.revision_table.filter(F.col("revision_id").startswith("b3")).select("revision_id", "table_version_id")


@query("v8b_delete_branch", "SELECT id FROM revision WHERE branch_id = 'b1'")
def v8b(s):
    return versioning.delete_branch(s, "b2").revision.select("id")


@query("v9_rename_cascade", f"SELECT o.id, replace(o.data, '\"customer\":\"' || c.a || '\"', '\"customer\":\"' || c.b || '\"') AS data FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4') o JOIN (SELECT x.id AS a, y.id AS b FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ct1') x JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ct4') y USING (created_id) WHERE x.id <> y.id) c ON json_extract_string(o.data, '$.customer') = c.a")
def v9(s):
    return versioning.rename_cascade(rows_of(s, "ot4"), ORDERS, "customer", renames(rows_of(s, "ct1"), rows_of(s, "ct4")))


@query("v11_removal_guard", f"SELECT json_extract_string(r.data, '$.customer') AS target, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.customer') IN ('customer-4-r', 'customer-6', 'customer-7') GROUP BY 1")
def v11(s):
    removed = rows_of(s, "ct4").filter("id in ('customer-4-r', 'customer-6', 'customer-7')")
    return versioning.blocking_references(removed, rows_of(s, "ot4"), [["customer"]]).groupBy("target").agg(F.count("*").alias("n"))


@query("v16_orphan_sweep", "SELECT (SELECT count(*) FROM table_version) - 1 AS n_tables, count(*) AS n_rows FROM row_version WHERE version_id IN (SELECT row_version_id FROM row_table)")
def v16(s):
    after = versioning.sweep(s)
    return after.table_version.agg(F.count("*").alias("n_tables")).crossJoin(after.row_version.agg(F.count("*").alias("n_rows")))


UNITS = " UNION ALL ".join([
    f"SELECT DISTINCT table_created_id, row_id AS row, 'rowReplace' AS kind, '' AS path FROM {DRAFT} WHERE replaced",
    f"SELECT table_created_id, row_created_id, CASE WHEN from_id IS NULL THEN 'rowCreate' ELSE 'rowDelete' END, '' FROM {DRAFT} WHERE one_sided AND NOT replaced",
    f"SELECT table_created_id, row_created_id, 'rowRename', '' FROM {DRAFT} WHERE from_id <> to_id",
    *[f"SELECT table_created_id, row_created_id, 'field', '{f}' FROM {DRAFT} WHERE NOT one_sided AND json_extract_string(from_data, '$.{f}') IS DISTINCT FROM json_extract_string(to_data, '$.{f}')" for f in FIELDS],
])


def units(s):
    return planner.row_units(draft.reported_pairs(s, "r5", "r6"), FIELDS)


@query("g1_row_units", f"SELECT table_created_id, row, kind, path FROM ({UNITS}) AS u")
def g1(s):
    return units(s).select("table_created_id", "row", "kind", "path")


@query("a6b_rows_with_units", f"SELECT table_created_id, count(DISTINCT row) AS rows_with_units, count(*) > 0 AS has_row_units FROM ({UNITS}) AS u GROUP BY 1")
def a6b(s):
    return draft.unit_counts(units(s))


@query("g2_selection", f"SELECT row, kind FROM ({UNITS}) AS u WHERE kind IN ('field', 'rowDelete') AND row <> 'c5'")
def g2(s):
    return planner.select(units(s), [{"kind": "field"}, {"kind": "rowDelete"}], [{"row": "c5"}]).select("row", "kind")


@query("g5_id_collisions", f"SELECT row_id AS id, 2::BIGINT AS n FROM {DRAFT} WHERE replaced GROUP BY 1")
def g5(s):
    pairs = draft.reported_pairs(s, "r5", "r6")
    return planner.row_id_collisions(rows_of(s, "ot4").select("id"), pairs.filter("change_type = 'ADDED'").select(F.col("to_id").alias("id")))


OUTCOMES = f"SELECT table_created_id, row, CASE WHEN count(*) FILTER (a) = 0 AND bool_or(kind = 'rowCreate') THEN 'absent' WHEN count(*) FILTER (a) = 0 THEN 'structureSide' WHEN bool_and(a) AND bool_or(kind = 'rowDelete') THEN 'absent' WHEN bool_and(a) THEN 'otherSide' ELSE 'merge' END AS outcome FROM (SELECT *, kind IN ('field', 'rowDelete') AS a FROM ({UNITS}) AS u) AS v GROUP BY 1, 2"


@query("g6_outcomes", OUTCOMES)
def g6(s):
    u = units(s)
    return planner.row_outcomes(u, planner.select(u, [{"kind": ["field", "rowDelete"]}]))


@query("g6b_table_outcomes", f"SELECT table_created_id, CASE WHEN bool_and(outcome = 'structureSide') THEN 'base' WHEN bool_and(outcome IN ('otherSide', 'absent')) THEN 'other' ELSE 'mixed' END AS outcome FROM ({OUTCOMES}) AS o GROUP BY 1")
def g6b(s):
    return planner.table_outcomes(g6(s))


@query("g7_merged_rows", f"SELECT row_created_id, json_extract_string(to_data, '$.cents') AS cents, json_extract_string(from_data, '$.status') AS status FROM {DRAFT} WHERE NOT one_sided")
def g7(s):
    return planner.merged(draft.reported_pairs(s, "r5", "r6"), planner.select(units(s), [{"path": "cents"}]), ["cents", "status"])


MERGED = f"SELECT row_created_id, '{{\"cents\":' || json_extract_string(to_data, '$.cents') || ',\"customer\":\"' || json_extract_string(from_data, '$.customer') || '\",\"priority\":\"' || json_extract_string(from_data, '$.priority') || '\",\"status\":\"' || json_extract_string(from_data, '$.status') || '\"}}' AS data FROM {DRAFT} WHERE NOT one_sided"


@query("g7b_merged_documents", f"SELECT *, md5(data) AS hash FROM ({MERGED}) AS m")
def g7b(s):
    return planner.merged_documents(draft.reported_pairs(s, "r5", "r6"), planner.select(units(s), [{"path": "cents"}]), ORDERS)


@query("g6c_moved_rows", OUTCOMES.replace("WHEN bool_and(a) THEN 'otherSide'", "WHEN bool_and(a) AND bool_or(kind = 'rowCreate') THEN 'move'").replace("'field', 'rowDelete'", "'field', 'rowDelete', 'rowReplace', 'rowCreate'"))
def g6c(s):
    """With another structure on the draft's side, whole new rows are moved, and whole changed ones merged."""
    u = units(s)
    return planner.row_outcomes(u, u, u.select("table_created_id"))


@query("g19b_partial_commit", f"SELECT r.created_id, CASE WHEN d.change_type = 'MODIFIED' THEN d.to_data ELSE r.data END AS data FROM {ROWS} LEFT JOIN {DRAFT} ON d.row_created_id = r.created_id AND d.from_id IS NOT NULL WHERE k.table_version_id = 'ot4' AND (d.change_type IS NULL OR d.change_type <> 'REMOVED' OR d.replaced)")
def g19b(s):
    """Changed amounts and removed rows are committed, replaced rows are not: the new head's table."""
    after = planner.apply_partial(s, "b1", lambda u: planner.select(u, [{"kind": ["field", "rowDelete"]}]), ORDERS, "r7", 79)
    version = tables_of(after, "r7").filter("created_id = 'to'").select("version_id").first()[0]
    return rows_of(after, version).select("created_id", "data")


@query("g13b_target_problems", f"SELECT 'row' AS kind, 'status: not in the list' AS detail, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot6' AND json_extract_string(r.data, '$.status') = 'P' UNION ALL SELECT 'reference', json_extract_string(r.data, '$.customer'), count(*) FROM {ROWS} WHERE k.table_version_id = 'ot6' AND json_extract_string(r.data, '$.customer') NOT IN (SELECT id FROM ({SIDE}'r6' AND t.created_id = 'tc') AS c) GROUP BY 2")
def g13b(s):
    schema = {"type": "object", "properties": ORDERS["properties"] | {"status": {"type": "string", "enum": ["F", "O"]}}}
    return planner.target_problems(s, "r6", "orders", schema, {"customer": "clients"}).filter("n > 0")


@query("g5b_table_collisions", "SELECT id, count(*) AS n FROM (SELECT DISTINCT t.created_id, t.id FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id UNION SELECT 'x' || created_id, id FROM table_version WHERE created_id < 'tg') AS x GROUP BY id HAVING count(*) > 1")
def g5b(s):
    linked = s.table_version.join(s.revision_table.select(F.col("table_version_id").alias("version_id")), "version_id", "left_semi").select("created_id", "id")
    return planner.table_id_collisions(linked.unionByName(s.table_version.filter("created_id < 'tg'").select(F.concat(F.lit("x"), "created_id").alias("created_id"), "id")))


@query("g3_scope", "WITH RECURSIVE e AS (SELECT table_id AS a, target_id AS b FROM schema_fk WHERE table_id <> 'supplier' UNION SELECT target_id, table_id FROM schema_fk WHERE table_id <> 'supplier'), seen(key) AS (SELECT 'orders' UNION SELECT e.b FROM e JOIN seen ON e.a = seen.key) SELECT key FROM seen")
def g3(s):
    links = s.schema_fk.filter("table_id <> 'supplier'").select(F.col("table_id").alias("a"), F.col("target_id").alias("b"))
    return planner.scope(links, s.branch.sparkSession.createDataFrame([("orders",)], "key string"))


@table_query("g4_closure", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 3 AS b FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey % 4 = 1 AND p_partkey > 7), seen(key) AS (SELECT p_partkey FROM part WHERE p_partkey % 41 = 2 UNION SELECT e.b FROM e JOIN seen ON e.a = seen.key) SELECT key, key % 3 = 0 AND key % 2 = 0 AS blocks FROM seen")
def g4(spark, sf_dir):
    """Closure over edges by a rule: parts require their threefold or a smaller one; some are excluded and block."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    edges = p.filter("key % 5 <> 0").select("key", (F.col("key") * 3).alias("requires")).unionByName(p.filter("key % 4 = 1 and key > 7").select("key", (F.col("key") - 7).alias("requires")))
    excluded = edges.select(F.col("requires").alias("key")).unionByName(p).distinct().filter("key % 6 = 0")
    return planner.closure(p.filter("key % 41 = 2"), edges, excluded)


@table_query("g9_status", "SELECT k, CASE WHEN k % 11 = 10 THEN 'blocked' WHEN k % 4 = 0 AND k % 7 <> 3 THEN 'empty' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'stale' WHEN k % 7 = 3 THEN 'blocked' WHEN k % 5 = 2 AND k % 8 < 4 THEN 'required' ELSE 'ready' END AS status FROM (SELECT p_partkey AS k FROM part) AS p")
def g9(spark, sf_dir):
    k = F.col("k")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    expected = F.when(k % 2 == 0, F.lit("a"))
    return p.select("k", planner.status(k % 11 != 10, k % 4, (k % 5 == 2).cast("int"), (k % 7 == 3).cast("int"), k % 8 >= 4, expected, F.when(k % 3 == 1, "b").otherwise("a")).alias("status"))


@query("g8_fingerprint", "SELECT true AS same, false AS other")
def g8(s):
    u = units(s)
    a, b, c = planner.fingerprint(u), planner.fingerprint(u.orderBy(F.desc("key"))), planner.fingerprint(u.filter("kind = 'field'"))
    return s.branch.sparkSession.createDataFrame([(a == b, a == c)], "same boolean, other boolean")


@query("g10_estimate", f"SELECT table_created_id, count(*) AS changed_rows, count(*) FILTER (outcome = 'merge') AS per_row_work FROM ({OUTCOMES}) AS o GROUP BY 1")
def g10(s):
    links = tables_of(s, "r5").select(F.col("version_id").alias("table_version_id"), F.col("created_id").alias("table_created_id"))
    links = s.row_table.join(links, "table_version_id").groupBy("table_created_id").agg(F.count("*").alias("n_links"))
    return planner.estimate(g6(s), links).select("table_created_id", "changed_rows", "per_row_work")


@query("g11_plan_coverage", f"SELECT kind, count(*) AS n, count(DISTINCT row) AS n_rows FROM ({UNITS}) AS u GROUP BY 1")
def g11(s):
    return units(s).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("row").alias("n_rows"))


@query("g13_target_references", f"SELECT json_extract_string(r.data, '$.customer') AS target, count(*) AS n FROM {ROWS} WHERE k.table_version_id = 'ot6' AND json_extract_string(r.data, '$.customer') NOT IN (SELECT id FROM ({SIDE}'r6' AND t.created_id = 'tc') AS c) GROUP BY 1")
def g13(s):
    from tessera.operators.references import dangling

    return dangling(rows_of(s, "ot6"), [["customer"]], rows_of(s, "ct4")).select("target", "n")


@query("l14_backfill_order", "SELECT unnest(['nation', 'clients', 'customer', 'orders', 'supplier']) AS table_id, unnest([0, 1, 2, 3, 4]) AS place")
def l14(s):
    refs: dict[str, set[str]] = {"nation": set()}
    for r in s.schema_fk.collect():  # tables
        refs.setdefault(r["table_id"], set()).add(r["target_id"])
    return s.branch.sparkSession.createDataFrame([(t, i) for i, t in enumerate(planner.backfill_order(refs))], "table_id string, place int")


@query("l15_linear_revisions", "SELECT id, CAST(row_number() OVER (ORDER BY sequence) - 1 AS INT) AS place FROM revision WHERE branch_id = 'b1'")
def l15(s):
    parents = {r["id"]: r["parent_id"] for r in s.revision.filter("branch_id = 'b1'").collect()}  # revisions of a branch
    return s.branch.sparkSession.createDataFrame([(r, i) for i, r in enumerate(planner.linear_order(parents))], "id string, place int")


@query("u3_link_difference", "SELECT row_version_id FROM row_table WHERE table_version_id = 'ot4' EXCEPT SELECT row_version_id FROM row_table WHERE table_version_id = 'ot2'")
def u3(s):
    links = lambda t: s.row_table.filter(F.col("table_version_id") == t).select("row_version_id")
    return links("ot4").join(links("ot2"), "row_version_id", "left_anti")


@query("a18_json_page", f"SELECT count(*) AS n, sum(length(from_id))::BIGINT AS chars FROM {pairs_sql('r3', 'r4')} WHERE change_type = 'REMOVED'")
def a18(s):
    from tessera.operators.diff import row_changes

    gone = row_changes(s, "r3", "r4", kinds=["REMOVED"], columns=()).select(F.to_json(F.struct("from_id")).alias("j"))
    return gone.select(F.get_json_object("j", "$.from_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.length("id")).alias("chars"))


@query("a17_distinct_rows", "SELECT count(DISTINCT created_id) AS rows, count(DISTINCT hash) AS contents FROM row_version")
def a17(s):
    return s.row_version.agg(F.count_distinct("created_id").alias("rows"), F.count_distinct("hash").alias("contents"))
