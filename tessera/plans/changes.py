"""Differences, drafts, statistics and history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import diff, draft, history
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query

SIDE = "SELECT r.created_id, r.id, r.version_id, r.hash, r.schema_hash, r.meta, r.published_at, r.updated_at, r.data, t.created_id AS table_created_id FROM row_version r JOIN row_table k ON k.row_version_id = r.version_id JOIN table_version t ON t.version_id = k.table_version_id JOIN revision_table l ON l.table_version_id = t.version_id WHERE NOT t.system AND l.revision_id = "
KIND = "CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' WHEN a.id <> b.id AND a.{0} <> b.{0} THEN 'RENAMED_AND_MODIFIED' WHEN a.id <> b.id THEN 'RENAMED' WHEN a.{0} <> b.{0} THEN 'MODIFIED' END"


def pairs_sql(a: str, b: str) -> str:
    return f"(SELECT coalesce(a.created_id, b.created_id) AS row_created_id, coalesce(b.table_created_id, a.table_created_id) AS table_created_id, a.id AS from_id, b.id AS to_id, a.version_id AS from_version_id, b.version_id AS to_version_id, a.hash AS from_hash, b.hash AS to_hash, a.data AS from_data, b.data AS to_data, a.updated_at AS from_updated_at, b.updated_at AS to_updated_at, {KIND.format('hash')} AS change_type FROM ({SIDE}'{a}') a FULL JOIN ({SIDE}'{b}') b ON a.created_id = b.created_id) AS p"


COLUMNS = ["row_created_id", "table_created_id", "from_id", "to_id", "from_version_id", "to_version_id", "from_hash", "to_hash", "change_type"]
PICK = ", ".join(COLUMNS)
STATS = "count(*) AS total, count(*) FILTER (change_type = 'ADDED') AS added, count(*) FILTER (change_type = 'REMOVED') AS removed, count(*) FILTER (change_type LIKE 'RENAMED%') AS renamed, count(*) FILTER (change_type LIKE '%MODIFIED') AS modified"


@query("q5_row_changes", f"SELECT {PICK} FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL")
def q5(s):
    return diff.row_changes(s, "r3", "r4").select(*COLUMNS)


@query("q5b_row_changes_page", f"SELECT {PICK}, to_data FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL AND table_created_id = 'to' ORDER BY coalesce(to_updated_at, from_updated_at) DESC, row_created_id LIMIT 50 OFFSET 10")
def q5b(s):
    page = diff.page_with_payload(diff.row_changes(s, "r3", "r4", "to", columns=("version_id",)), s, diff.ROW_ORDER(), 10, 50)
    return page.select(*COLUMNS, "to_data")


@query("p9_search_wildcards", f"SELECT {PICK} FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL AND (from_id ILIKE '%R_1%' OR to_id ILIKE '%R_1%')")
def p9(s):
    return diff.row_changes(s, "r3", "r4", search="R_1").select(*COLUMNS)


@query("p11_row_kinds", f"SELECT {PICK} FROM {pairs_sql('r3', 'r4')} WHERE change_type IN ('RENAMED', 'RENAMED_AND_MODIFIED')")
def p11(s):
    return diff.row_changes(s, "r3", "r4", kinds=["RENAMED"]).select(*COLUMNS)


@query("a1_row_stats", f"SELECT {STATS} FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL")
def a1(s):
    return diff.change_counts(diff.row_changes(s, "r3", "r4", columns=()))


@query("a4_count_changes", f"SELECT count(*) AS n FROM {pairs_sql('r3', 'r5')} WHERE change_type = 'ADDED'")
def a4(s):
    return diff.row_changes(s, "r3", "r5", kinds=["ADDED"], columns=()).agg(F.count("*").alias("n"))


T = "SELECT t.* FROM table_version t JOIN revision_table l ON l.table_version_id = t.version_id WHERE NOT t.system AND l.revision_id = "
TABLES = f"(SELECT coalesce(a.created_id, b.created_id) AS created_id, a.id AS from_id, b.id AS to_id, a.version_id AS from_version_id, b.version_id AS to_version_id, lower({KIND.format('version_id')}) AS change_type FROM ({T}'r3') a FULL JOIN ({T}'r4') b ON a.created_id = b.created_id) AS t"


@query("q7_table_changes", f"SELECT * FROM {TABLES} WHERE change_type IS NOT NULL")
def q7(s):
    return diff.table_changes(s, "r3", "r4")


@query("q7b_table_row_stats", f"SELECT t.created_id, t.change_type AS table_change, s.total FROM {TABLES} LEFT JOIN (SELECT table_created_id, count(*) AS total FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL GROUP BY 1) s ON s.table_created_id = t.created_id WHERE t.change_type IS NOT NULL")
def q7b(s):
    per = diff.row_changes(s, "r3", "r4", columns=()).groupBy(F.col("table_created_id").alias("created_id")).agg(F.count("*").alias("total"))
    return diff.table_changes(s, "r3", "r4").join(per, "created_id", "left").select("created_id", F.col("change_type").alias("table_change"), "total")


@query("p12_table_kinds", f"SELECT * FROM {TABLES} WHERE change_type = 'modified'")
def p12(s):
    return diff.table_changes(s, "r3", "r4", ["MODIFIED"])


@query("a2_table_stats", f"SELECT {STATS.replace('change_type', 'upper(change_type)')} FROM {TABLES} WHERE change_type IS NOT NULL")
def a2(s):
    return diff.change_counts(diff.table_changes(s, "r3", "r4"))


@query("q8_revision_changes", f"SELECT t.total AS tables_total, t.added AS tables_added, t.removed AS tables_removed, t.renamed AS tables_renamed, t.modified AS tables_modified, r.total AS rows_total, r.added AS rows_added, r.removed AS rows_removed, r.renamed AS rows_renamed, r.modified AS rows_modified, t.total + r.total AS total_changes FROM (SELECT {STATS.replace('change_type', 'upper(change_type)')} FROM {TABLES} WHERE change_type IS NOT NULL) t CROSS JOIN (SELECT {STATS} FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL) r")
def q8(s):
    return diff.revision_changes(s, "r4")


@query("q9_has_row_diffs", "SELECT 'r3r4' AS k, true AS has_diffs UNION ALL SELECT 'r4r5', false")
def q9(s):
    one = lambda a, b: diff.has_row_diffs(s, a, b, "to").select(F.lit(a + b).alias("k"), "has_diffs")
    return one("r3", "r4").unionByName(one("r4", "r5"))


@query("q10_has_table_diffs", "SELECT 'r3r4' AS k, true AS has_diffs UNION ALL SELECT 'r4r5', false UNION ALL SELECT 'r5r6', true")
def q10(s):
    one = lambda a, b: diff.has_table_diffs(s, a, b).select(F.lit(a + b).alias("k"), "has_diffs")
    return one("r3", "r4").unionByName(one("r4", "r5")).unionByName(one("r5", "r6"))


@query("q11_content_diffs", f"SELECT coalesce(a.created_id, b.created_id) AS created_id FROM (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot4') a FULL JOIN (SELECT r.* FROM {ROWS} WHERE k.table_version_id = 'ot6') b USING (created_id) WHERE a.version_id IS DISTINCT FROM b.version_id AND (a.id IS DISTINCT FROM b.id OR a.hash IS DISTINCT FROM b.hash OR a.schema_hash IS DISTINCT FROM b.schema_hash OR a.published_at IS DISTINCT FROM b.published_at)")
def q11(s):
    return diff.content_diffs(s, "ot4", "ot6").select("created_id")


FIELDS = ["cents", "customer", "priority", "status"]
FIELD_SQL = " UNION ALL ".join(f"SELECT row_created_id, '{f}' AS field_path, json_extract_string(from_data, '$.{f}') AS old_value, json_extract_string(to_data, '$.{f}') AS new_value FROM c" for f in FIELDS)


@query("q12_field_changes", f"WITH c AS (SELECT * FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL AND table_created_id = 'to') SELECT *, CASE WHEN old_value IS NULL THEN 'FIELD_ADDED' WHEN new_value IS NULL THEN 'FIELD_REMOVED' ELSE 'FIELD_MODIFIED' END AS field_change FROM ({FIELD_SQL}) AS x WHERE old_value IS DISTINCT FROM new_value")
def q12(s):
    return diff.field_changes(diff.row_changes(s, "r3", "r4", "to"), FIELDS)


@query("q6_resolve_table", "SELECT 'clients' AS table_id, 'tc' AS created_id UNION ALL SELECT 'part', 'tp' UNION ALL SELECT 'customer', 'tc'")
def q6(s):
    from tessera.sources.store import tables_of

    names = s.branch.sparkSession.createDataFrame([("clients",), ("part",), ("customer",), ("nothing",)], "table_id string")
    side = lambda r, c: tables_of(s, r).select(F.col("id").alias("table_id"), F.col("created_id").alias(c))
    both = names.join(side("r4", "b"), "table_id", "left").join(side("r3", "a"), "table_id", "left")
    return both.select("table_id", F.coalesce("b", "a").alias("created_id")).filter("created_id is not null")


@query("q15_new_migrations", f"SELECT r.id, r.data FROM {ROWS} WHERE k.table_version_id = 'zm4' AND r.id NOT IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'zm1')")
def q15(s):
    from tessera.operators.scan import migrations

    return migrations(s, "r4").join(migrations(s, "r3").select("id"), "id", "left_anti").select("id", "data")


@query("q13_schema_impact", f"SELECT r.id, json_extract_string(p, '$.op') AS op, split_part(json_extract_string(p, '$.path'), '/', 3) AS field FROM {ROWS}, unnest(CAST(json_extract(r.data, '$.patches') AS JSON[])) AS u(p) WHERE k.table_version_id = 'zm4' AND r.id NOT IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'zm1')")
def q13(s):
    new = q15(s).withColumn("p", F.explode(F.from_json(F.get_json_object("data", "$.patches"), "array<struct<op:string,path:string>>")))
    return new.select("id", F.col("p.op").alias("op"), F.regexp_extract("p.path", "/properties/([^/]+)", 1).alias("field"))


SAVED = "(SELECT l.revision_id, r.id AS table_id, json_extract_string(v, '$.id') AS id, json_extract_string(v, '$.name') AS name, coalesce(json_extract_string(v, '$.search'), '') AS search, json_extract_string(r.data, '$.defaultViewId') = json_extract_string(v, '$.id') AS is_default FROM row_version r JOIN row_table k ON k.row_version_id = r.version_id JOIN revision_table l ON l.table_version_id = k.table_version_id JOIN table_version t ON t.version_id = k.table_version_id, unnest(CAST(json_extract(r.data, '$.views') AS JSON[])) AS u(v) WHERE t.id = 'sys_views')"
VIEW_KIND = "CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.name <> b.name THEN 'renamed' WHEN a.search <> b.search THEN 'modified' END"
VIEW_CHANGES = f"SELECT * FROM (SELECT table_id, id, {VIEW_KIND} AS kind, coalesce(a.is_default, false) <> coalesce(b.is_default, false) AS default_changed FROM (SELECT * FROM {SAVED} AS x WHERE revision_id = 'r3') a FULL JOIN (SELECT * FROM {SAVED} AS x WHERE revision_id = 'r4') b USING (table_id, id)) AS v WHERE kind IS NOT NULL OR default_changed"


@query("q14_view_changes", VIEW_CHANGES)
def q14(s):
    return diff.view_changes(s, "r3", "r4")


@query("a16_view_counts", f"SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'renamed') AS renamed, count(*) FILTER (kind = 'modified') AS modified FROM ({VIEW_CHANGES}) AS c")
def a16(s):
    return q14(s).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "renamed", "modified")])


LEDGER_NEW = f"SELECT json_extract_string(r.data, '$.tableId') AS name FROM {ROWS} WHERE k.table_version_id = 'zm4' AND r.id NOT IN (SELECT r.id FROM {ROWS} WHERE k.table_version_id = 'zm1')"


@query("q7c_table_change_details", f"SELECT t.*, coalesce(s.n, 0) AS n_rows, (SELECT count(*) FROM ({LEDGER_NEW}) AS e WHERE e.name IN (t.from_id, t.to_id)) AS n_entries, (SELECT count(*) FROM ({VIEW_CHANGES}) AS w WHERE w.kind IS NOT NULL AND w.table_id IN (t.from_id, t.to_id)) AS n_views FROM {TABLES} LEFT JOIN (SELECT table_created_id, count(*) AS n FROM {pairs_sql('r3', 'r4')} WHERE change_type IS NOT NULL GROUP BY 1) s ON s.table_created_id = t.created_id WHERE t.change_type IS NOT NULL")
def q7c(s):
    return diff.table_change_details(s, "r3", "r4")


DRAFT = f"(SELECT *, coalesce(to_id, from_id) AS row_id, from_id IS NULL OR to_id IS NULL AS one_sided, (from_id IS NULL OR to_id IS NULL) AND count(*) FILTER (from_id IS NULL OR to_id IS NULL) OVER (PARTITION BY table_created_id, coalesce(to_id, from_id)) = 2 AS replaced FROM {pairs_sql('r5', 'r6')} WHERE change_type IS NOT NULL) AS d"
DRAFT_COLUMNS = ["row_created_id", "table_created_id", "row_id", "change_type", "one_sided", "replaced"]
DPICK = ", ".join(DRAFT_COLUMNS)


@query("q19_draft_pairs", f"SELECT {DPICK} FROM {DRAFT}")
def q19(s):
    return draft.reported_pairs(s, "r5", "r6", columns=draft.NARROW).select(*DRAFT_COLUMNS)


@query("a6_draft_row_counts", f"SELECT table_created_id, count(*) - r AS total, count(*) FILTER (change_type = 'ADDED') - r AS added, count(*) FILTER (change_type = 'REMOVED') - r AS removed, r AS replaced, count(*) FILTER (change_type LIKE 'RENAMED%') AS renamed, count(*) FILTER (change_type LIKE '%MODIFIED') AS modified FROM (SELECT *, (SELECT count(*) / 2 FROM {DRAFT} WHERE replaced)::BIGINT AS r FROM {DRAFT}) AS x GROUP BY table_created_id, r")
def a6(s):
    return draft.row_counts(draft.reported_pairs(s, "r5", "r6", columns=draft.NARROW, marked=False))


@query("a8_replaced_rows", f"SELECT row_id, max(coalesce(to_updated_at, from_updated_at)) AS replaced_at FROM {DRAFT} WHERE replaced GROUP BY row_id")
def a8(s):
    return draft.reported_pairs(s, "r5", "r6").filter("replaced").select("row_id", "replaced_at").distinct()


@query("a7_one_sided_tables", f"SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed FROM {TABLES}")
def a7(s):
    return diff.table_changes(s, "r3", "r4").agg(F.count_if(F.col("change_type") == "added").alias("added"), F.count_if(F.col("change_type") == "removed").alias("removed"))


@query("p10_plain_search", f"SELECT {DPICK} FROM {DRAFT} WHERE contains(lower(to_id), 'r-1') OR contains(lower(from_id), 'r-1')")
def p10(s):
    return draft.reported_pairs(s, "r5", "r6").filter(draft.search_matches("R-1")).select(*DRAFT_COLUMNS)


@query("p13_draft_kinds", f"SELECT {DPICK} FROM {DRAFT} WHERE replaced OR (NOT replaced AND change_type IN ('MODIFIED', 'RENAMED_AND_MODIFIED'))")
def p13(s):
    return draft.reported_pairs(s, "r5", "r6").filter(draft.kind_matches(["REPLACED", "MODIFIED"])).select(*DRAFT_COLUMNS)


@query("p14_draft_row_ids", f"SELECT {DPICK} FROM {DRAFT} WHERE row_id IN ('order-6', 'order-16', 'order-5')")
def p14(s):
    return draft.row_id_matches(draft.reported_pairs(s, "r5", "r6"), ["order-6", "order-16", "order-5"]).select(*DRAFT_COLUMNS)


@query("l9_recent_order", f"SELECT row_created_id FROM (SELECT *, CASE WHEN replaced THEN max(coalesce(to_updated_at, from_updated_at)) OVER (PARTITION BY row_id) ELSE to_updated_at END AS moment FROM {DRAFT}) AS x ORDER BY moment IS NULL, moment DESC, row_id, row_created_id LIMIT 60")
def l9(s):
    return draft.reported_pairs(s, "r5", "r6").orderBy(*draft.recent_order()).limit(60).select("row_created_id")


@query("l8b_draft_page_with_ties", f"SELECT row_created_id FROM (SELECT row_created_id, rank() OVER (ORDER BY row_id) AS n FROM {DRAFT}) AS x WHERE n <= 20")
def l8b(s):
    return draft.page_by_ids(draft.reported_pairs(s, "r5", "r6", columns=draft.NARROW, marked=False), 20).select("row_created_id")


@query("q20_companions", f"SELECT row_created_id FROM {DRAFT} WHERE replaced AND change_type = 'REMOVED'")
def q20(s):
    pairs = draft.reported_pairs(s, "r5", "r6")
    return draft.companions(pairs, pairs.filter("change_type = 'ADDED'")).select("row_created_id")


@query("q23_changed_pairs_keyset", f"SELECT row_created_id, row_id FROM {DRAFT} WHERE row_id > 'order-2' ORDER BY row_id, row_created_id LIMIT 100")
def q23(s):
    return draft.reported_pairs(s, "r5", "r6").filter("row_id > 'order-2'").orderBy("row_id", "row_created_id").limit(100).select("row_created_id", "row_id")


@query("q24_page_renames", f"SELECT row_created_id, from_id, to_id FROM {pairs_sql('r3', 'r4')} WHERE from_id <> to_id AND from_id NOT IN (SELECT id FROM ({SIDE}'r4') AS z)")
def q24(s):
    pairs = diff.row_changes(s, "r3", "r4", columns=()).filter("from_id <> to_id")
    held = s.row_version.join(diff.linked_rows(s, "r4").select("version_id"), "version_id", "left_semi").select(F.col("id").alias("from_id"))
    return pairs.join(held, "from_id", "left_anti").select("row_created_id", "from_id", "to_id")


@query("a15_draft_summary", f"SELECT count(DISTINCT table_created_id) AS tables, count(*) - count(*) FILTER (replaced) / 2 AS total_rows FROM {DRAFT}")
def a15(s):
    per = draft.row_counts(draft.reported_pairs(s, "r5", "r6", columns=draft.NARROW, marked=False))
    return per.agg(F.count("*").alias("tables"), F.sum("total").cast("double").alias("total_rows"))


@query("q21_field_value", f"SELECT r.id, substr(json_extract_string(r.data, '$.name'), 3, 6) AS slice, length(json_extract_string(r.data, '$.name')) AS units FROM {ROWS} WHERE k.table_version_id = 'pt1'")
def q21(s):
    from tessera.sources.store import rows_of

    return draft.field_value(rows_of(s, "pt1"), "name", 2, 6).select("id", "slice", "units")


@query("q22_value_budget", f"SELECT r.id, left(json_extract_string(r.data, '$.name'), 7) AS cut, octet_length(encode(json_extract_string(r.data, '$.name')))::INT AS bytes, sha256(json_extract_string(r.data, '$.name')) AS sha FROM {ROWS} WHERE k.table_version_id = 'pt1'")
def q22(s):
    from tessera.sources.store import rows_of

    v = F.get_json_object("data", "$.name")
    return rows_of(s, "pt1").select("id", draft.cut_bytes(v, 7).alias("cut"), F.octet_length(v).alias("bytes"), F.sha2(v, 256).alias("sha"))


@query("u4_unshared_rows", "SELECT row_version_id AS version_id, 'head' AS side FROM row_table WHERE table_version_id = 'ot4' AND row_version_id NOT IN (SELECT row_version_id FROM row_table WHERE table_version_id = 'ot6') UNION ALL SELECT row_version_id, 'draft' FROM row_table WHERE table_version_id = 'ot6' AND row_version_id NOT IN (SELECT row_version_id FROM row_table WHERE table_version_id = 'ot4')")
def u4(s):
    a, b = diff.linked_rows(s, "r5", "to"), diff.linked_rows(s, "r6", "to")
    only = lambda x, y, n: x.join(y, "version_id", "left_anti").select("version_id", F.lit(n).alias("side"))
    return only(a, b, "head").unionByName(only(b, a, "draft"))


INTRO = "(SELECT k.row_version_id AS version_id, min(v.sequence) AS introduced_seq FROM row_table k JOIN table_version t ON t.version_id = k.table_version_id JOIN revision_table l ON l.table_version_id = t.version_id JOIN revision v ON v.id = l.revision_id WHERE t.created_id = 'to' AND ((v.branch_id = 'b2' AND v.sequence <= 8) OR (v.branch_id = 'b1' AND v.sequence <= 3)) GROUP BY 1) AS i"


@query("a9_introductions", f"SELECT * FROM {INTRO}")
def a9(s):
    return history.introductions(s, "f8", "to")


EVENTS = f"(SELECT *, lead(id) OVER w AS before_id, lead(hash) OVER w AS before_hash, row_number() OVER w AS n FROM row_version JOIN {INTRO} USING (version_id) WINDOW w AS (PARTITION BY created_id ORDER BY introduced_seq DESC)) AS e"


@query("w1_row_events", f"SELECT version_id, introduced_seq, CASE WHEN before_id IS NULL THEN 'CREATED' ELSE concat_ws('+', CASE WHEN id <> before_id THEN 'RENAMED' END, CASE WHEN hash <> before_hash THEN 'MODIFIED' END) END AS kinds FROM {EVENTS} WHERE before_id IS NULL OR id <> before_id OR hash <> before_hash")
def w1(s):
    return history.events(s, "f8", "to").select("version_id", "introduced_seq", F.array_join("kinds", "+").alias("kinds"))


@query("q16_previous_states", f"SELECT version_id, introduced_seq, data FROM {EVENTS} WHERE n > 1")
def q16(s):
    return history.previous_states(s, "f8", "to").select("version_id", "introduced_seq", "data")


@query("q17_integrity", "SELECT false AS cycle, false AS gap, false AS cross_project, false AS draft_in_ancestry, false AS duplicate_table, false AS duplicate_row, false AS reappearing_row")
def q17(s):
    return history.integrity(s, "f8", "to")


@query("w2_not_newest", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY branch_id ORDER BY sequence DESC) AS n FROM revision) AS x WHERE n > 1")
def w2(s):
    return s.revision.withColumn("n", F.row_number().over(Window.partitionBy("branch_id").orderBy(F.desc("sequence")))).filter("n > 1").select("id")
