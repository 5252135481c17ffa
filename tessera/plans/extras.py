"""Ledger scans, views, structure, and the remaining steps of planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.jsonpath import canonical, foreign_key_paths, schema_type
from tessera.functions.plugins import published_at
from tessera.functions.schema import apply_patches
from tessera.operators import diff, draft, versioning
from tessera.plans.changes import DRAFT, TABLES
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query
from tessera.sources.store import revision_rows, rows_of, tables_of

ORDERS = {"type": "object", "properties": {"cents": {"type": "number"}, "customer": {"type": "string"}, "priority": {"type": "string"}, "status": {"type": "string"}}}


def small(s, rows, schema):
    return s.branch.sparkSession.createDataFrame(rows, schema)


@query("l7_table_order", f"SELECT created_id, change_type FROM {TABLES} WHERE change_type IS NOT NULL ORDER BY coalesce(to_id, from_id), created_id LIMIT 3")
def l7(s):
    return diff.table_changes(s, "r3", "r4").orderBy(F.coalesce("to_id", "from_id"), "created_id").limit(3).select("created_id", "change_type")


@query("l11_page_over_tables", "SELECT t.id AS table_id, r.id FROM row_version r JOIN row_table k ON k.row_version_id = r.version_id JOIN table_version t ON t.version_id = k.table_version_id JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'r5' AND NOT t.system ORDER BY t.id, r.id LIMIT 101 OFFSET 130")
def l11(s):
    """A page over the rows of several tables, with one more row to look ahead."""
    return revision_rows(s, "r5").select("table_id", "id").orderBy("table_id", "id").offset(130).limit(101)


@query("f4_published_at", f"SELECT r.id, coalesce(nullif(json_extract_string(r.data, '$.none'), ''), json_extract_string(r.data, '$.status'), 'x') AS published FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def f4(s):
    at = lambda p: F.get_json_object("data", f"$.{p}")
    return rows_of(s, "ot4").select("id", published_at([at("none"), at("status")], F.lit("x")).alias("published"))


@query("f10_reference_paths", "SELECT 'customer' AS path, 'clients' AS target UNION ALL SELECT 'lines.*.part', 'part'")
def f10(s):
    schema = {"type": "object", "properties": {"customer": {"type": "string", "foreignKey": "clients"}, "lines": {"type": "array", "items": {"type": "object", "properties": {"part": {"type": "string", "foreignKey": "part"}}}}}}
    return small(s, [(".".join(p), t) for p, t in foreign_key_paths(schema)], "path string, target string")


@query("v12_table_update", f"SELECT r.id, r.version_id || CASE WHEN r.readonly THEN '@80' ELSE '' END AS version_id, json_extract_string(r.data, '$.status') AS state FROM {ROWS} WHERE k.table_version_id = 'ot6'")
def v12(s):
    """A whole table through schema patches: typed once, rewritten, and written back as new versions."""
    typed = rows_of(s, "ot6").select("id", F.from_json("data", schema_type(ORDERS)).alias("d"))
    out, _ = apply_patches(typed, "d", ORDERS, [{"op": "move", "from": "/properties/status", "path": "/properties/state"}])
    after = versioning.update_rows(s, "ot6", out.dropDuplicates(["id"]).select("id", F.to_json("d").alias("data")), 80)
    return rows_of(after, "ot6").select("id", "version_id", F.get_json_object("data", "$.state").alias("state"))


@query("q28_ledger_scan", f"SELECT l.revision_id, count(*) AS entries, count(*) FILTER (contains(r.data, '\"rename\"')) AS renames FROM {ROWS} JOIN revision_table l ON l.table_version_id = k.table_version_id JOIN table_version t ON t.version_id = k.table_version_id WHERE t.id = 'sys_migrations' GROUP BY 1")
def q28(s):
    tables = s.table_version.filter("id = 'sys_migrations'").select(F.col("version_id").alias("table_version_id"))
    links = s.revision_table.join(tables, "table_version_id").join(s.row_table, "table_version_id").withColumnRenamed("row_version_id", "version_id")
    kind = F.get_json_object("data", "$.changeType")
    return links.join(s.row_version.select("version_id", "data"), "version_id").groupBy("revision_id").agg(F.count("*").alias("entries"), F.count_if(kind == "rename").alias("renames"))


@query("g19_apply_whole_draft", f"SELECT r.version_id, r.id FROM {ROWS} WHERE k.table_version_id = 'ot6'")
def g19(s):
    """Applying every unit is the draft's own commit."""
    after = versioning.commit(s, "b1", "r10")
    version = tables_of(after, "r10").filter("created_id = 'to'").select("version_id").first()[0]
    return rows_of(after, version).select("version_id", "id")


@query("q19b_effective_content", f"SELECT count(*) AS n FROM {DRAFT} WHERE NOT one_sided AND from_data <> to_data")
def q19b(s):
    pairs = draft.reported_pairs(s, "r5", "r6").filter(~F.col("one_sided"))
    return pairs.filter(canonical("from_data") != canonical("to_data")).agg(F.count("*").alias("n"))
