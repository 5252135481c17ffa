"""A version graph over fixed tables, as SQL that Spark and other engines run alike.

Everything is derived by integer and text arithmetic on keys. `orders` is the main table. Order k falls, by k % 10,
between revisions r3 and r4 of the branch main, into: 0 added, 1 removed, 2 renamed, 3 modified, 4 renamed and modified,
5 a new version of equal content, 6 to 9 unchanged. k % 7 = 3 has a version at r2 already, k % 5 = 2 one on the branch
feature, which forks at r3. In the draft r6, k % 11 = 5 is modified, k % 11 = 6 removed, and half of the latter are
replaced by a new row of the same id. `customer` follows the same classes and its table is renamed; `part` goes and
`events` comes at r4; `supplier` stays. Times are milliseconds since 1970 as BIGINT.
"""

from __future__ import annotations

ORDER_DATA = """'{"cents":' || (CAST(round(o_totalprice * 100) AS BIGINT) + @add) || ',"customer":"customer-' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'"""
BEFORE = "CASE WHEN k % 7 = 3 AND s > 1 THEN 7 ELSE 0 END"
AFTER = "CASE WHEN s IN (4, 6) AND k % 10 IN (3, 4) THEN 100 ELSE 0 END"
LATER = "CASE WHEN s = 6 THEN 1000 WHEN s = 8 THEN 5000 WHEN s = 66 THEN 9 ELSE 0 END"

GRAPH: dict[str, str] = {
    "branch": """SELECT * FROM (VALUES ('b1', 'p1', 'main', true), ('b2', 'p1', 'feature', false)) AS t(id, project_id, name, is_root)""",
    "revision": """SELECT id, CAST(sequence AS INT) AS sequence, branch_id, parent_id, is_head, is_draft, is_start, has_changes FROM (VALUES
        ('r1', 1, 'b1', NULL, false, false, true, false), ('r2', 2, 'b1', 'r1', false, false, false, false), ('r3', 3, 'b1', 'r2', false, false, false, false),
        ('r4', 4, 'b1', 'r3', false, false, false, false), ('r5', 5, 'b1', 'r4', true, false, false, false), ('r6', 6, 'b1', 'r5', false, true, false, true),
        ('f7', 7, 'b2', 'r3', false, false, true, false), ('f8', 8, 'b2', 'f7', true, false, false, false), ('f9', 9, 'b2', 'f8', false, true, false, false))
        AS t(id, sequence, branch_id, parent_id, is_head, is_draft, is_start, has_changes)""",
    "table_version": """SELECT version_id, created_id, id, readonly, system, CAST(created_at AS BIGINT) AS created_at, CAST(updated_at AS BIGINT) AS updated_at FROM (VALUES
        ('ot1', 'to', 'orders', true, false, 1, 1), ('ot2', 'to', 'orders', true, false, 1, 2), ('ot4', 'to', 'orders', true, false, 1, 4), ('ot6', 'to', 'orders', false, false, 1, 6), ('ot8', 'to', 'orders', true, false, 1, 8),
        ('ct1', 'tc', 'customer', true, false, 2, 2), ('ct4', 'tc', 'clients', true, false, 2, 4), ('pt1', 'tp', 'part', true, false, 3, 3), ('et4', 'te', 'events', true, false, 4, 4), ('st1', 'ts', 'supplier', true, false, 5, 5),
        ('zs1', 'zs', 'sys_schemas', true, true, 0, 0), ('zs4', 'zs', 'sys_schemas', true, true, 0, 4), ('zm1', 'zm', 'sys_migrations', true, true, 0, 0), ('zm4', 'zm', 'sys_migrations', true, true, 0, 4), ('zv1', 'zv', 'sys_views', true, true, 0, 0), ('zv4', 'zv', 'sys_views', true, true, 0, 4), ('xx1', 'xx', 'orphan', true, false, 9, 9))
        AS t(version_id, created_id, id, readonly, system, created_at, updated_at)""",
    "revision_table": """SELECT r AS revision_id, unnested AS table_version_id FROM (
        SELECT r, explode_(v) AS unnested FROM (VALUES ('r1', 'ot1 ct1 pt1 st1 zs1 zm1 zv1'), ('r2', 'ot2 ct1 pt1 st1 zs1 zm1 zv1'), ('r3', 'ot2 ct1 pt1 st1 zs1 zm1 zv1'),
        ('r4', 'ot4 ct4 et4 st1 zs4 zm4 zv4'), ('r5', 'ot4 ct4 et4 st1 zs4 zm4 zv4'), ('r6', 'ot6 ct4 et4 st1 zs4 zm4 zv4'),
        ('f7', 'ot2 ct1 pt1 st1 zs1 zm1 zv1'), ('f8', 'ot8 ct1 pt1 st1 zs1 zm1 zv1'), ('f9', 'ot8 ct1 pt1 st1 zs1 zm1 zv1')) AS t(r, v)) AS u""",
    "row_version": f"""SELECT version_id, created_id, id, readonly, data, '{{}}' AS meta, md5(data) AS hash, schema_hash, CAST(created_at AS BIGINT) AS created_at, CAST(updated_at AS BIGINT) AS updated_at, CAST(published_at AS BIGINT) AS published_at FROM (
        SELECT 'v' || k || '-' || s AS version_id, CASE WHEN s = 66 THEN 'd' ELSE 'c' END || k AS created_id,
               'order-' || k || CASE WHEN s IN (4, 6, 66) AND k % 10 IN (2, 4) THEN '-r' ELSE '' END AS id, s NOT IN (6, 66) AS readonly,
               {ORDER_DATA.replace("@add", f"{BEFORE} + {AFTER} + {LATER}")} AS data, 'h-orders' AS schema_hash, k AS created_at, s * 1000000 + k % 1000 AS updated_at, k % 50 AS published_at
        FROM (SELECT *, o_orderkey AS k FROM orders) AS o CROSS JOIN (VALUES (1), (2), (4), (6), (8), (66)) AS v(s)
        WHERE (s = 1 AND k % 10 <> 0) OR (s = 2 AND k % 7 = 3 AND k % 10 <> 0) OR (s = 4 AND k % 10 IN (0, 2, 3, 4, 5)) OR (s = 6 AND k % 11 = 5 AND k % 10 <> 1) OR (s = 8 AND k % 5 = 2 AND k % 10 <> 0) OR (s = 66 AND k % 22 = 6 AND k % 10 <> 1)
        UNION ALL
        SELECT 'u' || k || '-' || s, 'cc' || k, 'customer-' || k || CASE WHEN s = 4 AND k % 10 IN (2, 4) THEN '-r' ELSE '' END, true,
               '{{"balance":' || (CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN s = 4 AND k % 10 IN (3, 4) THEN 100 ELSE 0 END) || ',"name":"' || c_name || '","nation":"nation-' || c_nationkey || '","segment":"' || c_mktsegment || '"}}',
               'h-customer', k, s * 1000000 + k % 1000, k % 50
        FROM (SELECT *, c_custkey AS k FROM customer) AS c CROSS JOIN (VALUES (1), (4)) AS v(s) WHERE (s = 1 AND k % 10 <> 0) OR (s = 4 AND k % 10 IN (0, 2, 3, 4, 5))
        UNION ALL
        SELECT 'p' || p_partkey, 'cp' || p_partkey, 'part-' || p_partkey, true, '{{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}}', 'h-part', p_partkey, 1000000, 0 FROM part
        UNION ALL
        SELECT 's' || s_suppkey, 'cs' || s_suppkey, 'supplier-' || s_suppkey, true, '{{"name":"' || s_name || '","nation":"nation-' || s_nationkey || '"}}', 'h-supplier', s_suppkey, 1000000, 0 FROM supplier
        UNION ALL
        SELECT 'e' || event_id, 'ce' || event_id, 'event-' || event_id, true, '{{"cents":' || CAST(round(value * 100) AS BIGINT) || ',"props":' || coalesce(props, '{{}}') || ',"type":"' || event_type || '","user":"user-' || user_id || '"}}', 'h-events', event_id, 4000000 + event_id % 7, event_id % 50 FROM events
        UNION ALL
        SELECT version_id, created_id, id, true, data, 'h-system', created_at, created_at, created_at FROM (VALUES
            ('zs-orders', 'czs-orders', 'orders', '{{"type":"object","properties":{{"cents":{{"type":"number","default":0}},"customer":{{"type":"string","default":"","foreignKey":"customer"}},"priority":{{"type":"string","default":""}},"status":{{"type":"string","default":""}}}}}}', 1),
            ('zs-customer', 'czs-customer', 'customer', '{{"type":"object","properties":{{"balance":{{"type":"number","default":0}},"name":{{"type":"string","default":""}},"nation":{{"type":"string","default":"","foreignKey":"nation"}},"segment":{{"type":"string","default":""}}}}}}', 1),
            ('zs-supplier', 'czs-supplier', 'supplier', '{{"type":"object","properties":{{"name":{{"type":"string","default":""}},"nation":{{"type":"string","default":"","foreignKey":"nation"}}}}}}', 1),
            ('zm-1', 'czm-1', '2024-01-01T00:00:00.000Z', '{{"changeType":"init","tableId":"orders"}}', 1),
            ('zm-2', 'czm-2', '2024-01-02T00:00:00.000Z', '{{"changeType":"init","tableId":"customer"}}', 1),
            ('zm-3', 'czm-3', '2024-02-01T00:00:00.000Z', '{{"changeType":"update","tableId":"orders","patches":[{{"op":"add","path":"/properties/priority"}}]}}', 4),
            ('zm-4', 'czm-4', '2024-02-02T00:00:00.000Z', '{{"changeType":"rename","tableId":"customer","nextTableId":"clients"}}', 4),
            ('zv-1', 'czv-1', 'orders', '{{"version":1,"defaultViewId":"v1","views":[{{"id":"v1","name":"All"}},{{"id":"v2","name":"Open","search":"O"}}]}}', 1),
            ('zv-4', 'czv-1', 'orders', '{{"version":1,"defaultViewId":"v3","views":[{{"id":"v1","name":"Everything"}},{{"id":"v3","name":"Big"}}]}}', 4)
        ) AS t(version_id, created_id, id, data, created_at)) AS all_rows""",
    "row_table": """SELECT row_version_id, table_version_id FROM (
        SELECT 'v' || k || '-1' AS row_version_id, 'ot1' AS table_version_id FROM (SELECT o_orderkey AS k FROM orders) AS o WHERE k % 10 <> 0
        UNION ALL SELECT 'v' || k || CASE WHEN k % 7 = 3 THEN '-2' ELSE '-1' END, 'ot2' FROM (SELECT o_orderkey AS k FROM orders) AS o WHERE k % 10 <> 0
        UNION ALL SELECT 'v' || k || CASE WHEN k % 10 IN (0, 2, 3, 4, 5) THEN '-4' WHEN k % 7 = 3 THEN '-2' ELSE '-1' END, 'ot4' FROM (SELECT o_orderkey AS k FROM orders) AS o WHERE k % 10 <> 1
        UNION ALL SELECT 'v' || k || CASE WHEN k % 11 = 5 THEN '-6' WHEN k % 11 = 6 THEN '-66' WHEN k % 10 IN (0, 2, 3, 4, 5) THEN '-4' WHEN k % 7 = 3 THEN '-2' ELSE '-1' END, 'ot6' FROM (SELECT o_orderkey AS k FROM orders) AS o WHERE k % 10 <> 1 AND (k % 11 <> 6 OR k % 22 = 6)
        UNION ALL SELECT 'v' || k || CASE WHEN k % 5 = 2 THEN '-8' WHEN k % 7 = 3 THEN '-2' ELSE '-1' END, 'ot8' FROM (SELECT o_orderkey AS k FROM orders) AS o WHERE k % 10 <> 0
        UNION ALL SELECT 'u' || k || '-1', 'ct1' FROM (SELECT c_custkey AS k FROM customer) AS c WHERE k % 10 <> 0
        UNION ALL SELECT 'u' || k || CASE WHEN k % 10 IN (0, 2, 3, 4, 5) THEN '-4' ELSE '-1' END, 'ct4' FROM (SELECT c_custkey AS k FROM customer) AS c WHERE k % 10 <> 1
        UNION ALL SELECT 'p' || p_partkey, 'pt1' FROM part UNION ALL SELECT 's' || s_suppkey, 'st1' FROM supplier UNION ALL SELECT 'e' || event_id, 'et4' FROM events
        UNION ALL SELECT * FROM (VALUES ('zs-orders', 'zs1'), ('zs-customer', 'zs1'), ('zs-supplier', 'zs1'), ('zs-orders', 'zs4'), ('zs-customer', 'zs4'), ('zs-supplier', 'zs4'), ('zm-1', 'zm1'), ('zm-2', 'zm1'),
            ('zm-1', 'zm4'), ('zm-2', 'zm4'), ('zm-3', 'zm4'), ('zm-4', 'zm4'), ('zv-1', 'zv1'), ('zv-4', 'zv4')) AS t(a, b)) AS l""",
    "schema_fk": """SELECT * FROM (VALUES ('orders', 'customer', 'customer'), ('orders', 'clients', 'customer'), ('customer', 'nation', 'nation'), ('clients', 'nation', 'nation'), ('supplier', 'nation', 'nation')) AS t(table_id, target_id, path)""",
    "file_blob": """SELECT 'f-' || p || '-' || hash AS id, p AS project_id, hash, size, deleted_at FROM (
        SELECT 'p' || (doc_id % 3) AS p, md5(text) AS hash, CAST(max(n_chars) AS BIGINT) AS size, CASE WHEN min(doc_id) % 6 = 0 THEN CAST(min(doc_id) AS BIGINT) END AS deleted_at
        FROM documents GROUP BY 'p' || (doc_id % 3), md5(text)) AS b""",
    "file_blob_row": """SELECT 'f-p' || (doc_id % 3) || '-' || md5(text) AS blob_id, 'v' || doc_id || '-1' AS row_version_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 0""",
    "project_file_usage": """SELECT * FROM (SELECT 'p' || (doc_id % 3) AS project_id, CAST(sum(n_chars) AS BIGINT) AS file_bytes FROM documents WHERE doc_id % 3 < 2 GROUP BY 'p' || (doc_id % 3)) AS u""",
}
BASE = ("orders", "customer", "part", "supplier", "events", "documents", "conversations", "lineitem", "pages", "nation")


def sql_for(engine: str, text: str) -> str:
    """Spark spells the word list of a revision differently; all else is the same."""
    return text.replace("explode_(v)", "explode(split(v, ' '))" if engine == "spark" else "unnest(string_split(v, ' '))")


def with_graph(query: str) -> str:
    """The query for another engine, with the graph's tables as common table expressions."""
    used = [name for name in GRAPH if name in query]
    heads = ",\n".join(f"{name} AS ({sql_for('other', GRAPH[name])})" for name in used)
    head = query.lstrip()
    recursive = head.upper().startswith("WITH RECURSIVE")
    if head.upper().startswith("WITH"):
        head = head[len("WITH RECURSIVE") if recursive else len("WITH") :].lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads + ', ' if heads else ''}{head}"
    return f"WITH {heads} {head}" if heads else head
