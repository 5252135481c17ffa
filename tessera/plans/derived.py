"""Search, sub-schemas, formulas, validation, digests and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formula, search
from tessera.functions.jsonpath import ref_paths, schema_type
from tessera.functions.schema import apply_patches, violations
from tessera.operators import files, subschema
from tessera.plans.lookups import ROWS
from tessera.plans.registry import query, read, table_query
from tessera.sources.store import rows_of

WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("q2_search_rows", "SELECT r.version_id, t.id AS table_id FROM row_version r JOIN row_table k ON k.row_version_id = r.version_id JOIN table_version t ON t.version_id = k.table_version_id JOIN revision_table l ON l.table_version_id = t.version_id WHERE l.revision_id = 'r5' AND NOT t.system AND regexp_matches(lower(regexp_replace(r.data, '\"[a-z]+\":', ' ', 'g')), '\\bcustomer\\b') AND regexp_matches(lower(regexp_replace(r.data, '\"[a-z]+\":', ' ', 'g')), '\\b7\\b')")
def q2(s):
    from tessera.sources.store import revision_rows

    return revision_rows(s, "r5").filter(search.search_column(search.json_values(F.col("data")), "customer 7")).select("version_id", "table_id")


def documents(kind: str, text: str):
    return lambda spark, sf_dir: read(spark, sf_dir, "documents").filter(search.search_column(F.col("text"), text, kind)).select("doc_id")


HAVE = f"(SELECT doc_id, {WORDS.format('text')} AS w FROM documents) AS d"
table_query("q4_search_plain", f"SELECT doc_id FROM {HAVE} WHERE list_contains(w, 'the') AND list_contains(w, 'that')")(documents("plain", "The that"))
table_query("q4b_search_phrase", f"SELECT doc_id FROM {HAVE} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")(documents("phrase", "of the"))
table_query("q4c_search_prefix", f"SELECT doc_id FROM {HAVE} WHERE len(list_filter(w, lambda x: starts_with(x, 'erin'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'tion'))) > 0")(documents("prefix", "erin tion"))
table_query("q4d_search_tsquery", f"SELECT doc_id FROM {HAVE} WHERE (list_contains(w, 'the') OR list_contains(w, 'der')) AND NOT list_contains(w, 'und') AND len(list_filter(w, lambda x: starts_with(x, 'er'))) > 0")(documents("tsquery", "(the | der) & !und & er:*"))


@query("q3_matches", f"SELECT r.version_id AS key, 'name' AS path, json_extract_string(r.data, '$.name') AS value, CASE WHEN list_contains(string_split(json_extract_string(r.data, '$.name'), ' '), 'red') THEN 100 ELSE 10 END + greatest(0, 20 - length(json_extract_string(r.data, '$.name'))) AS relevance FROM {ROWS} WHERE k.table_version_id = 'pt1' AND contains(json_extract_string(r.data, '$.name'), 'red')")
def q3(s):
    found = search.leaves(rows_of(s, "pt1"))
    return search.matches(found, "red").select("key", "path", "value", "relevance")


MEDIA = {"type": "object", "properties": {"file": {"$ref": "File"}, "media": {"type": "object", "properties": {"items": {"type": "array", "items": {"$ref": "File"}}}}}}


@table_query("q18_subschema_items", "SELECT 'doc-' || doc_id AS row_id, 'file' AS field_path, md5(text) AS hash, CAST(n_chars AS DOUBLE) AS size FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'doc-' || doc_id, 'media.items[' || i || ']', md5(text || i), CAST(n_chars + i AS DOUBLE) FROM documents, (VALUES (0), (1)) AS v(i) WHERE doc_id % 3 <> 0")
def q18(spark, sf_dir):
    rows = media_rows(spark, sf_dir)
    items = subschema.items(rows, MEDIA, "File", "documents")
    return items.filter(F.col("data.status") == "uploaded").select("row_id", "field_path", F.col("data.hash").alias("hash"), F.col("data.size").alias("size"))


def media_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    one = lambda h, n: F.struct(F.when(F.col("doc_id") % 3 == 0, "ready").otherwise("uploaded").alias("status"), h.alias("hash"), n.cast("double").alias("size"))
    media = F.struct(F.array(*[one(F.md5(F.concat("text", F.lit(str(i)))), F.col("n_chars") + i) for i in (0, 1)]).alias("items"))
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.concat(F.lit("v-"), "doc_id").alias("version_id"), F.to_json(F.struct(one(F.md5("text"), F.col("n_chars")).alias("file"), media.alias("media"))).alias("data"), F.col("doc_id").alias("created_at"))


@table_query("u5_ref_paths", "SELECT 'file' AS path UNION ALL SELECT 'media.items.*'")
def u5(spark, sf_dir):
    return spark.createDataFrame([(".".join(p),) for p in ref_paths(MEDIA, "File")], "path string")


LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, lead(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem) AS l"


def line_arrays(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", F.col("l_suppkey"), F.col("l_quantity").cast("double").alias("value"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("root", F.struct(F.lit(2.0).alias("rate")))


@table_query("w3_array_neighbours", f"SELECT l_orderkey, CAST(i AS DOUBLE) AS place, CAST(coalesce(p, 0) AS DOUBLE) AS before, CAST(coalesce(x, 0) AS DOUBLE) AS after, CAST(q - coalesce(p, 0) AS DOUBLE) AS step, i = 0 AS is_first, CAST(q * 3 AS DOUBLE) AS scaled FROM {LINES}")
def w3(spark, sf_dir):
    f = {"place": "#index", "before": "if(isnull(@prev), 0, @prev.value)", "after": "if(isnull(@next), 0, @next.value)", "step": "value - if(isnull(@prev), 0, @prev.value)", "is_first": "#first", "scaled": "value * (1 + /rate)"}
    out = formula.compute_items(line_arrays(spark, sf_dir), "items", f, {"is_first": False}, "root").select("l_orderkey", F.explode_outer("items").alias("x"))
    return out.select("l_orderkey", *[F.col(f"x.{k}").alias(k) for k in f])


@table_query("f5_formulas", "SELECT o_orderkey, c * 2 AS doubled, c * 2 + 1 AS chained, CASE WHEN c > 20000000 THEN 'big' ELSE 'small' END AS size_class, greatest(c - 10000000, 0) AS above, -c AS negated FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS c FROM orders) AS o")
def f5(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.round(F.col("o_totalprice") * 100).cast("long").cast("double").alias("cents")).alias("d"))
    f = {"chained": "doubled + 1", "doubled": "cents * 2", "size_class": 'if(cents > 20000000, "big", "small")', "above": "max(cents - 10000000, 0)", "negated": "-cents"}
    return formula.compute(o, "d", f, {"size_class": ""}).select("o_orderkey", *[F.col(f"d.{k}").alias(k) for k in f])


@table_query("f6_formula_errors", "SELECT o_orderkey, CASE WHEN k = 0 THEN 0 ELSE 100 / k END AS ratio, CASE WHEN k = 0 THEN 0 ELSE 100 / k + 1 END AS next, CASE WHEN k = 0 THEN 'ratio,next' ELSE '' END AS errors FROM (SELECT o_orderkey, CAST(o_orderkey % 4 AS DOUBLE) AS k FROM orders) AS o")
def f6(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.struct((F.col("o_orderkey") % 4).cast("double").alias("k")).alias("d"))
    out = formula.compute(o, "d", {"ratio": "100 / k", "next": "ratio + 1"}, {})
    return out.select("o_orderkey", F.col("d.ratio").alias("ratio"), F.col("d.next").alias("next"), F.array_join("formula_errors", ",").alias("errors"))


@query("f2_metadata_fields", f"SELECT r.id AS row_id, r.created_id, r.hash, r.created_at FROM {ROWS} WHERE k.table_version_id = 'ct4'")
def f2(s):
    from tessera.functions.plugins import fill_metadata

    typed = rows_of(s, "ct4").withColumn("d", F.struct(F.lit("").alias("rowId"), F.lit("").alias("createdId"), F.lit("").alias("rowHash"), F.lit("").alias("createdAt")))
    schema = {"type": "object", "properties": {"rowId": {"$ref": "RowId"}, "createdId": {"$ref": "RowCreatedId"}, "rowHash": {"$ref": "RowHash"}, "createdAt": {"$ref": "RowCreatedAt"}}}
    d = fill_metadata(typed, "d", schema)
    return d.select(F.col("d.rowId").alias("row_id"), F.col("d.createdId").alias("created_id"), F.col("d.rowHash").alias("hash"), (F.unix_millis(F.to_timestamp("d.createdAt", "yyyy-MM-dd'T'HH:mm:ss.SSSX"))).alias("created_at"))


@table_query("f7_file_urls", "SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN 'https://files.example/' || md5(text) ELSE '' END AS url FROM documents")
def f7(spark, sf_dir):
    from tessera.functions.plugins import file_url

    rows = media_rows(spark, sf_dir).select("id", F.from_json("data", schema_type(MEDIA)).alias("d"))
    return rows.select("id", file_url(F.col("d.file"), "https://files.example/").alias("url"))


@query("f9_validation", f"SELECT r.id, 'status: not in the list' AS problem FROM {ROWS} WHERE k.table_version_id = 'ot4' AND json_extract_string(r.data, '$.status') = 'P'")
def f9(s):
    schema = {"type": "object", "properties": {"cents": {"type": "number"}, "customer": {"type": "string", "pattern": "^customer-[0-9]+$"}, "priority": {"type": "string"}, "status": {"type": "string", "enum": ["F", "O"]}}, "required": ["cents", "status"], "additionalProperties": False}
    return rows_of(s, "ot4").select("id", F.explode(violations("data", schema)).alias("problem"))


@query("f11_schema_patches", f"SELECT r.id, 'none' AS note, json_extract_string(r.data, '$.status') AS state, CAST(json_extract_string(r.data, '$.cents') AS DOUBLE)::BIGINT::VARCHAR AS amount FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def f11(s):
    before = {"type": "object", "properties": {"cents": {"type": "number"}, "customer": {"type": "string"}, "priority": {"type": "string"}, "status": {"type": "string"}}}
    patches = [{"op": "add", "path": "/properties/note", "value": {"type": "string", "default": "none"}}, {"op": "move", "from": "/properties/status", "path": "/properties/state"}, {"op": "remove", "path": "/properties/priority"}, {"op": "move", "from": "/properties/cents", "path": "/properties/amount"}, {"op": "replace", "path": "/properties/amount", "value": {"type": "string", "default": ""}}]
    typed = rows_of(s, "ot4").select("id", F.from_json("data", schema_type(before)).alias("d"))
    out, _ = apply_patches(typed, "d", before, patches)
    return out.select("id", "d.note", "d.state", "d.amount")


@query("f12_patch_values", f"SELECT r.id, 'X' AS status, json_extract_string(r.data, '$.customer') AS customer FROM {ROWS} WHERE k.table_version_id = 'ot4'")
def f12(s):
    from tessera.functions.schema import patch_value

    d = F.from_json("data", "struct<cents:double,customer:string,priority:string,status:string>")
    out = rows_of(s, "ot4").select("id", patch_value(d, "status", F.lit("X")).alias("d"))
    return out.select("id", "d.status", "d.customer")


DIGESTED = ("version_id", "created_id", "id", "hash", "schema_hash", "published_at", "meta")
LINE = " || '|' || ".join(f"CAST(r.{c} AS VARCHAR)" for c in DIGESTED)


@query("a10_table_digest", f"SELECT table_version_id, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(digest, ',' ORDER BY bucket)) AS digest FROM (SELECT k.table_version_id, left(md5(r.version_id), 2) AS bucket, count(*) AS n, md5(string_agg({LINE}, ',' ORDER BY r.version_id)) AS digest FROM {ROWS} WHERE k.table_version_id IN ('ot4', 'ct4') GROUP BY 1, 2) AS b GROUP BY 1")
def a10(s):
    return table_digest(s, ["ot4", "ct4"])


def table_digest(s, versions, digits=2):
    """Count and a digest of each table's rows: rows are dealt to 16^digits buckets by a hash of their version, each bucket
    is digested in the order of versions, and then the buckets in their order, so that no task gathers a whole table."""
    links = s.row_table.filter(F.col("table_version_id").isin(versions)).withColumnRenamed("row_version_id", "version_id")
    rows = s.row_version.select(*DIGESTED).join(links, "version_id")
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in DIGESTED])
    per = rows.withColumn("line", line).groupBy("table_version_id", F.left(F.md5("version_id"), F.lit(digits)).alias("bucket"))
    per = per.agg(F.count("*").alias("n"), F.md5(F.expr("listagg(line, ',') WITHIN GROUP (ORDER BY line)")).alias("digest"))
    return per.groupBy("table_version_id").agg(F.sum("n").alias("n"), F.md5(F.expr("listagg(digest, ',') WITHIN GROUP (ORDER BY bucket)")).alias("digest"))


@query("a10b_commutative_digest", "SELECT table_version_id, count(*) AS n, bit_xor(('0x' || left(md5(row_version_id), 15))::BIGINT) AS digest, CAST(sum(('0x' || substr(md5(row_version_id), 16, 12))::BIGINT) AS BIGINT) AS total FROM row_table GROUP BY 1")
def a10b(s):
    """An order-free digest: hashes of row versions added up and put together by exclusive or, combined before the shuffle."""
    return commutative_digest(s.row_table)


def commutative_digest(links):
    """Halves of the hashes are added apart, as a sum of whole ones leaves a BIGINT at some 65,000 rows; the total is the
    sum's lowest 64 bits, in two's complement: the sum itself as long as a BIGINT holds it."""
    part = lambda at, n: F.conv(F.substring(F.md5("row_version_id"), at, n), 16, 10).cast("long")
    per = links.groupBy("table_version_id").agg(F.count("*").alias("n"), F.bit_xor(part(1, 15)).alias("digest"), F.sum(part(16, 6)).alias("high"), F.sum(part(22, 6)).alias("low"))
    carried = F.col("high") + F.shiftright("low", 24)
    return per.select("table_version_id", "n", "digest", F.shiftleft(carried, 24).bitwiseOR(F.col("low").bitwiseAND(F.lit((1 << 24) - 1))).alias("total"))


@query("a11_schema_hashes", f"SELECT k.table_version_id, r.schema_hash, count(*) AS n FROM {ROWS} GROUP BY 1, 2")
def a11(s):
    links = s.row_table.withColumnRenamed("row_version_id", "version_id")
    return s.row_version.select("version_id", "schema_hash").join(links, "version_id").groupBy("table_version_id", "schema_hash").agg(F.count("*").alias("n"))


@query("a12_storage_bytes", "SELECT p AS project_id, coalesce(file_bytes, 0) AS file_bytes FROM (VALUES ('p0'), ('p2')) AS v(p) LEFT JOIN project_file_usage u ON u.project_id = p")
def a12(s):
    return files.storage_bytes(s, ["p0", "p2"])


@query("a13_validate_bytes", "SELECT project_id, coalesce(e, 0) AS expected, coalesce(n, 0) AS blobs, coalesce(file_bytes, 0) AS file_bytes, coalesce(l, 0) AS links, coalesce(e, 0) - coalesce(file_bytes, 0) AS drift FROM (SELECT project_id, sum(size)::BIGINT AS e, count(*) AS n FROM file_blob WHERE deleted_at IS NULL GROUP BY 1) a FULL JOIN project_file_usage USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS l FROM file_blob_row k JOIN file_blob b ON b.id = k.blob_id GROUP BY 1) x USING (project_id)")
def a13(s):
    return files.validate_bytes(s)


@query("q25_pending_deletions", "SELECT DISTINCT hash FROM file_blob WHERE deleted_at IS NOT NULL AND hash NOT IN (SELECT hash FROM file_blob WHERE deleted_at IS NULL) AND hash > '4' ORDER BY hash LIMIT 1000")
def q25(s):
    return files.pending_deletions(s, "4")


@query("v18_tombstone_orphans", "SELECT u.project_id, greatest(0, file_bytes - coalesce(f, 0)) AS file_bytes, coalesce(f, 0) AS freed FROM project_file_usage u LEFT JOIN (SELECT project_id, sum(size)::BIGINT AS f FROM file_blob WHERE deleted_at IS NULL AND id NOT IN (SELECT blob_id FROM file_blob_row) GROUP BY 1) x USING (project_id)")
def v18(s):
    return files.tombstone(s, 99)[1]


@query("a14_freed_bytes", "SELECT project_id, sum(size)::BIGINT AS freed FROM file_blob WHERE deleted_at IS NULL AND id NOT IN (SELECT blob_id FROM file_blob_row) GROUP BY 1")
def a14(s):
    return files.orphan_blobs(s).groupBy("project_id").agg(F.sum("size").alias("freed"))


def file_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 3 == 0, "ready").otherwise("uploaded")
    return d.select(F.concat(F.lit("v"), "doc_id").alias("row_version_id"), F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("project_id"), F.struct(status.alias("status"), F.md5("text").alias("hash"), F.col("n_chars").alias("size")).alias("file"))


@table_query("q26_file_references", "SELECT 'v' || doc_id AS row_version_id, 'p' || (doc_id % 5) AS project_id, md5(text) AS hash, CAST(n_chars AS BIGINT) AS size FROM documents WHERE doc_id % 3 <> 0")
def q26(spark, sf_dir):
    return files.references(file_rows(spark, sf_dir))


@table_query("q27_backfill", "SELECT p AS project_id, count(*) AS blobs, sum(n)::BIGINT AS links, sum(size)::BIGINT AS bytes FROM (SELECT 'p' || (doc_id % 5) AS p, md5(text) AS h, count(DISTINCT doc_id) AS n, min(n_chars) AS size FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2) AS x GROUP BY 1")
def q27(spark, sf_dir):
    return files.backfill(files.references(file_rows(spark, sf_dir)))


@table_query("v17_register_files", "SELECT r.p AS project_id, r.h AS hash, r.links, CASE WHEN b.id IS NULL THEN 'insert' WHEN b.deleted_at IS NOT NULL THEN 'reactivate' ELSE 'keep' END AS action, CASE WHEN b.id IS NULL THEN r.size WHEN b.deleted_at IS NOT NULL THEN b.size ELSE 0 END AS added_bytes FROM (SELECT 'p' || (doc_id % 5) AS p, md5(text) AS h, count(*) AS links, CAST(min(n_chars) AS BIGINT) AS size FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2) r LEFT JOIN file_blob b ON b.project_id = r.p AND b.hash = r.h")
def v17(spark, sf_dir):
    from tessera.sources.store import opened

    return files.register(opened(spark, sf_dir), files.references(file_rows(spark, sf_dir)))


@query("v19_restore_bytes", "SELECT project_id, coalesce(sum(size), 0)::BIGINT AS file_bytes FROM file_blob WHERE deleted_at IS NULL GROUP BY 1")
def v19(s):
    return files.validate_bytes(s).filter("blobs > 0").select("project_id", F.col("expected").alias("file_bytes"))
