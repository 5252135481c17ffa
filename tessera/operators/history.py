"""History of rows along a branch and its fork ancestry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.paging import decode_cursor, sort_hash
from tessera.sources.store import Store, dealt, parts_for


@dataclass
class HistoryError(Exception):
    flags: dict[str, bool]


def lineage(store: Store, revision_id: str) -> DataFrame:
    """branch_id, max_seq, depth: how far each branch of the ancestry counts. One step a fork, not a revision."""
    spark = store.revision.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE line(branch_id, max_seq, depth, seen) AS (
            SELECT branch_id, sequence, 0, array(branch_id) FROM {{revision}} WHERE id = '{revision_id}'
            UNION ALL
            SELECT p.branch_id, p.sequence, l.depth + 1, array_append(l.seen, p.branch_id)
            FROM line l JOIN {{revision}} s ON s.branch_id = l.branch_id AND s.is_start JOIN {{revision}} p ON p.id = s.parent_id
            WHERE NOT array_contains(l.seen, p.branch_id))
        SELECT branch_id, max_seq, depth FROM line""",
        revision=store.revision,
    )


def introductions(store: Store, revision_id: str, table_created_id: str) -> DataFrame:
    """version_id and the first sequence at which the lineage links it, for all rows of a table. Tables are brought to the
    driver, and links dealt by version before they are grouped, as a group has no more than one link a table version."""
    line = lineage(store, revision_id)
    revisions = store.revision.join(line, "branch_id").filter("sequence <= max_seq").select(F.col("id").alias("revision_id"), "sequence")
    tables = store.table_version.filter(F.col("created_id") == table_created_id).select(F.col("version_id").alias("table_version_id"))
    first = store.revision_table.join(revisions, "revision_id").join(tables, "table_version_id").groupBy("table_version_id").agg(F.min("sequence").alias("sequence"))
    held = dict(tuple(r) for r in first.select("table_version_id", "sequence").collect())  # table versions
    links = store.row_table.filter(F.col("table_version_id").isin(list(held)))
    seq = F.coalesce(*[F.when(F.col("table_version_id") == v, F.lit(n)) for v, n in held.items()], F.lit(None).cast("int"))
    links = links.select(F.col("row_version_id").alias("version_id"), seq.alias("introduced_seq"))
    return dealt(links, parts_for(links), "version_id").groupBy("version_id").agg(F.min("introduced_seq").alias("introduced_seq"))


def events(store: Store, revision_id: str, table_created_id: str) -> DataFrame:
    """Every semantic state of every row: created, renamed, modified or both; versions of equal id and content are none."""
    seen = introductions(store, revision_id, table_created_id)
    rows = store.row_version.join(seen, "version_id").select("version_id", F.col("created_id").alias("row_created_id"), "id", "hash", "introduced_seq")
    down = Window.partitionBy("row_created_id").orderBy(F.col("introduced_seq").desc(), F.col("version_id").desc())
    rows = rows.withColumns({"before": F.lead("version_id").over(down), "before_id": F.lead("id").over(down), "before_hash": F.lead("hash").over(down)})
    renamed, changed = F.col("id") != F.col("before_id"), F.col("hash") != F.col("before_hash")
    kinds = F.array_compact(F.array(F.when(F.col("before").isNull(), "CREATED"), F.when(renamed, "RENAMED"), F.when(changed, "MODIFIED")))
    return rows.withColumn("kinds", kinds).filter(F.size("kinds") > 0).drop("before", "before_id", "before_hash")


def previous_states(store: Store, revision_id: str, table_created_id: str, row_created_id: str | None = None, after: int | None = None, first: int | None = None) -> DataFrame:
    """Earlier states, newest first, without the current one; a page past a sequence, its documents joined last."""
    found = events(store, revision_id, table_created_id)
    if row_created_id is not None:
        found = found.filter(F.col("row_created_id") == row_created_id)
    down = Window.partitionBy("row_created_id").orderBy(F.col("introduced_seq").desc())
    found = found.withColumn("n", F.row_number().over(down)).filter("n > 1").drop("n")
    if after is not None:
        found = found.filter(F.col("introduced_seq") < after)
    if first is not None:
        if not 1 <= first <= 100:
            raise ValueError("first must be from 1 to 100")
        found = found.orderBy(F.col("introduced_seq").desc()).limit(first)
    return found.join(store.row_version.select("version_id", "data"), "version_id")


def row_page(store: Store, revision_id: str, table_created_id: str, row_created_id: str, first: int, cursor: str | None = None) -> DataFrame:
    """A page of a row's earlier states with the cursor after each. A cursor is bound to the tip, the table and the row that
    it was made for; another one is refused."""
    made_for = [{"tip": revision_id}, {"table": table_created_id}, {"row": row_created_id}]
    values = decode_cursor(cursor, made_for)
    if cursor is not None and (values is None or len(values) != 1 or not isinstance(values[0], int)):
        raise ValueError("the cursor is of another history")
    found = previous_states(store, revision_id, table_created_id, row_created_id, values[0] if values else None, first)
    bound = F.lit(sort_hash(made_for))
    text = F.concat(F.lit("[["), F.col("introduced_seq").cast("string"), F.lit('], "'), bound, F.lit('"]'))
    return found.withColumn("cursor", F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("=")))


def floor_revision(store: Store, points: DataFrame) -> DataFrame:
    """For each (branch_id, at): the latest revision of the branch with sequence <= at."""
    r = store.revision.select("branch_id", F.col("sequence").alias("found_seq"), F.col("id").alias("found_id"))
    return points.join(r, "branch_id").filter("found_seq <= at").groupBy("branch_id", "at").agg(F.max_by("found_id", "found_seq").alias("found_id"))


def integrity(store: Store, revision_id: str, table_created_id: str) -> DataFrame:
    """One row of flags: a fork that leads back to its own branch, a branch whose start or parent is missing, another
    project, a draft below the tip, a duplicate table or row in a revision, a row that comes back. Windows and
    one-row results are over branches and revisions, not rows."""
    line = lineage(store, revision_id)
    starts = line.join(store.revision.filter("is_start").select("branch_id", F.col("parent_id")), "branch_id", "left").join(store.revision.select(F.col("id").alias("parent_id"), F.col("branch_id").alias("parent_branch")), "parent_id", "left")
    starts = starts.join(store.branch.select(F.col("id").alias("branch_id"), "project_id", "is_root"), "branch_id", "left")
    seen = line.select(F.col("branch_id").alias("parent_branch"), F.col("depth").alias("parent_depth"))
    starts = starts.join(seen, "parent_branch", "left").join(store.revision.filter("is_start").select("branch_id", F.lit(True).alias("started")).distinct(), "branch_id", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    of_branches = starts.agg(
        some(F.col("parent_depth") <= F.col("depth")).alias("cycle"), some(F.col("started").isNull() | (F.col("parent_id").isNotNull() & F.col("parent_branch").isNull()) | (F.col("parent_id").isNull() & ~F.coalesce("is_root", F.lit(False)))).alias("gap"),
        (F.count_distinct("project_id") > 1).alias("cross_project"),
    )
    path = store.revision.join(line, "branch_id").filter("sequence <= max_seq")
    drafts = path.agg(F.coalesce(F.bool_or(F.col("is_draft") & (F.col("id") != revision_id)), F.lit(False)).alias("draft_in_ancestry"))
    tables = store.table_version.filter(F.col("created_id") == table_created_id).select(F.col("version_id").alias("table_version_id"))
    held = store.revision_table.join(path.select(F.col("id").alias("revision_id"), "sequence"), "revision_id").join(tables, "table_version_id")
    twice = held.groupBy("revision_id").count().agg(F.coalesce(F.bool_or(F.col("count") > 1), F.lit(False)).alias("duplicate_table"))
    rows = store.row_table.join(held.select("table_version_id").distinct(), "table_version_id").join(store.row_version.select(F.col("version_id").alias("row_version_id"), "created_id"), "row_version_id")
    row_twice = rows.groupBy("table_version_id", "created_id").count().agg(F.coalesce(F.bool_or(F.col("count") > 1), F.lit(False)).alias("duplicate_row"))
    order = held.groupBy("sequence").agg(F.min("table_version_id").alias("table_version_id")).withColumn("place", F.row_number().over(Window.orderBy("sequence")))  # one row a revision
    spans = rows.join(order, "table_version_id").groupBy("created_id").agg(F.count_distinct("place").alias("n"), F.max("place").alias("hi"), F.min("place").alias("lo"))
    back = spans.agg(F.coalesce(F.bool_or(F.col("n") < F.col("hi") - F.col("lo") + 1), F.lit(False)).alias("reappearing_row"))
    return of_branches.crossJoin(drafts).crossJoin(twice).crossJoin(row_twice).crossJoin(back)  # one row each


def assert_integrity(store: Store, revision_id: str, table_created_id: str) -> None:
    flags = integrity(store, revision_id, table_created_id).first().asDict()
    if any(flags.values()):
        raise HistoryError(flags)
