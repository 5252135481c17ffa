"""Planning partial commits: ledger replay, scope, units, closure, outcomes, status, estimates.

Row-sized sets are DataFrames; graphs over tables and ledger entries are small and handled on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import foreign_key_paths, schema_type, steps, values_at, with_target
from tessera.functions.plugins import Formulas
from tessera.functions.schema import patched, violations
from tessera.functions.views import problems
from tessera.operators.draft import reported_pairs
from tessera.operators.references import dangling
from tessera.sources.store import ROW_COLUMNS, Store, rows_of, scratch, table_at, tables_of

# Limits of one operation.
LIMITS = {"changed_rows": 20_000, "per_row_work": 2_000, "mixed_links": 100_000, "listed": 200}


@dataclass
class Slot:
    """One table through its renames."""

    names: list[str]
    schema: dict | None = None
    removed: bool = False
    problems: list[str] = field(default_factory=list)


def replay(entries: list[dict], schemas: dict[str, dict] | None = None) -> dict[str, Slot]:
    """Tables by their current names after init, update, rename and remove entries in order. A failing entry is recorded
    with its table and taints the tables that refer to it; the others go on."""
    now: dict[str, Slot] = {name: Slot([name], schema) for name, schema in (schemas or {}).items()}
    gone: list[Slot] = []

    def referrers(name: str) -> list[Slot]:
        return [s for s in now.values() if s.schema and any(t == name for _, t in foreign_key_paths(s.schema))]

    for e in entries:
        kind, name = e["changeType"], e["tableId"]
        slot = now.get(name)
        try:
            if kind == "init":
                if slot is not None:
                    raise ValueError(f"{name} exists")
                now[name] = Slot([name], e.get("schema"))
            elif slot is None:
                raise ValueError(f"{name} doesn't exist")
            elif kind == "update":
                slot.schema = patched(slot.schema or {"type": "object", "properties": {}}, e["patches"])
            elif kind == "rename":
                if e["nextTableId"] in now:
                    raise ValueError(f"{e['nextTableId']} exists")
                for other in referrers(name):
                    other.schema = with_target(other.schema, name, e["nextTableId"])
                now[e["nextTableId"]] = now.pop(name)
                slot.names.append(e["nextTableId"])
            elif kind == "remove":
                if any(s is not slot for s in referrers(name)):
                    raise ValueError(f"{name} is referred to")
                slot.removed = True
                gone.append(now.pop(name))
            else:
                raise ValueError(f"unknown change {kind}")
        except (ValueError, KeyError) as problem:
            bad = slot or now.setdefault(name, Slot([name]))
            bad.problems.append(f"{e.get('id', '?')}: {problem}")
            for other in referrers(name):
                if other is not bad:
                    other.problems.append(f"{e.get('id', '?')}: depends on {name}")
    return now | {f"{s.names[-1]} (removed {i})": s for i, s in enumerate(gone)}


def apply_migrations(entries: list[dict], done: set[str]) -> list[tuple[str, str]]:
    """Status of each entry applied in order: skipped if it is done already, else applied or failed, which ends the run."""
    out, so_far = [], []
    for e in entries:
        so_far.append(e)
        if e["id"] in done:
            out.append((e["id"], "skipped"))
        elif any(p.startswith(f"{e['id']}:") for s in replay(so_far).values() for p in s.problems):
            return [*out, (e["id"], "failed")]
        else:
            out.append((e["id"], "applied"))
    return out


def attribute(entries: list[dict], published: set[str], current: set[str]) -> list[tuple[str, str]]:
    """published, pending (of a table that there is now, through renames) or transient (of one that is gone again)."""
    names: dict[str, str] = {}
    for e in reversed([e for e in entries if e["id"] not in published]):
        if e["changeType"] == "rename":
            names[e["tableId"]] = names.get(e["nextTableId"], e["nextTableId"])
    now = lambda t: names.get(t, t)
    return [(e["id"], "published" if e["id"] in published else "pending" if now(e["tableId"]) in current else "transient") for e in entries]


def renumber(entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(new id, old key) of entries in order: an id that isn't later than the one before becomes a millisecond later."""
    from tessera.operators.versioning import next_migration_id

    out: list[tuple[str, str]] = []
    for key, at in entries:
        if out and at <= out[-1][0]:
            at = next_migration_id(datetime.fromisoformat(at.replace("Z", "+00:00")), [out[-1][0]], [])
        out.append((at, key))
    return out


def leaves(schema: dict, at: str = "") -> dict[str, dict]:
    if schema.get("type") == "object":
        return {k: v for name, sub in schema["properties"].items() for k, v in leaves(sub, f"{at}.{name}" if at else name).items()}
    return {at: schema}


def structure(before: dict, after: dict, patches: list[dict]) -> list[tuple[str, str]]:
    """(path, added, removed, moved, changed or annotated) of the leaves that differ, with moves taken from the patches."""
    from tessera.functions.schema import steps_of

    a, b = leaves(before), leaves(after)
    moved = {".".join(steps_of(p["path"])): ".".join(steps_of(p["from"])) for p in patches if p["op"] == "move"}
    out = [(new, "moved") for new, old in moved.items() if new in b and old in a]
    sources = {moved[new] for new, _ in out}
    out += [(p, "added") for p in b if p not in a and p not in moved]
    out += [(p, "removed") for p in a if p not in b and p not in sources]
    both = [p for p in b if p in a and a[p] != b[p]]
    return out + [(p, "changed" if a[p].get("type") != b[p].get("type") else "annotated") for p in both]


def backfill_order(references: dict[str, set[str]]) -> list[str]:
    """Tables so that each comes after those it refers to, in code point order; a cycle is cut at its first table."""
    left = {t: {r for r in refs if r in references and r != t} for t, refs in references.items()}
    out: list[str] = []
    while left:
        ready = sorted(t for t, refs in left.items() if not refs) or [min(left)]
        for t in ready[:1]:
            out.append(t)
            left.pop(t)
            for refs in left.values():
                refs.discard(t)
    return out


def linear_order(parents: dict[str, str | None]) -> list[str]:
    """Revisions from the first to the last by parent links within the set; one start, no forks."""
    if not parents:
        return []
    children: dict[str | None, list[str]] = defaultdict(list)
    for r, p in parents.items():
        children[p if p in parents else None].append(r)
    if len(children[None]) != 1 or any(len(c) > 1 for c in children.values()):
        raise ValueError("revisions aren't one line")
    out, at = [], children[None][0]
    while at is not None:
        out.append(at)
        at = children[at][0] if children.get(at) else None
    if len(out) != len(parents):
        raise ValueError("revisions form a cycle")
    return out


def scope(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tables (key) connected to the chosen ones (key) by links (a, b) of references, names or history."""
    both = links.select(F.col("a").alias("key"), F.col("b").alias("requires")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("requires")))
    return closure(chosen, both).select("key")


def row_units(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each unit of changed rows: key, kind, table_created_id, row_created_id, path.

    A one-sided row is one unit, or part of one if its id is replaced; a row on both sides has a unit for its rename, one
    for its columns and one for each changed leaf.
    """
    old, new = (lambda f: F.get_json_object("from_data", f"$.{f}")), (lambda f: F.get_json_object("to_data", f"$.{f}"))
    both = ~F.col("one_sided")
    leaf = [F.when(both & ~old(f).eqNullSafe(new(f)), F.struct(F.lit("field").alias("kind"), F.lit(f).alias("path"))) for f in fields]
    whole = F.when(F.col("replaced"), "rowReplace").when(F.col("from_id").isNull(), "rowCreate").when(F.col("to_id").isNull(), "rowDelete")
    rename = F.when(both & (F.col("from_id") != F.col("to_id")), F.struct(F.lit("rowRename").alias("kind"), F.lit("").alias("path")))
    columns = F.when(both & ~F.col("from_published_at").eqNullSafe(F.col("to_published_at")), F.struct(F.lit("rowColumns").alias("kind"), F.lit("publishedAt").alias("path")))
    each = F.array_compact(F.array(F.when(whole.isNotNull(), F.struct(whole.alias("kind"), F.lit("").alias("path"))), rename, columns, *leaf))
    who = F.when(F.col("replaced"), F.col("row_id")).otherwise(F.col("row_created_id"))
    x = pairs.withColumn("u", F.explode(each)).select("table_created_id", who.alias("row"), "u.kind", "u.path").distinct()
    return x.withColumn("key", F.concat_ws("/", "table_created_id", "kind", "row", "path"))


def select(units: DataFrame, selectors: list[dict] | None, exclude: list[dict] | None = None) -> DataFrame:
    """Units that fit any selector (all, without), less those that fit an exclusion. A selector gives columns and values."""

    def fits(s: dict):
        out = F.lit(True)
        for k, v in s.items():
            out = out & (F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v)
        return out

    chosen = F.lit(selectors is None)
    for s in selectors or []:
        chosen = chosen | fits(s)
    for s in exclude or []:
        chosen = chosen & ~fits(s)
    return units.filter(chosen)


def row_id_collisions(base_ids: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids that more than one row of the target would have: base rows that stay and rows taken from the other side."""
    return base_ids.select("id").unionAll(taken.select("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def row_outcomes(units: DataFrame, applied: DataFrame, restructured: DataFrame | None = None) -> DataFrame:
    """What becomes of each changed row when some of its units are applied: otherSide, move, structureSide, merge or absent.

    For a commit the head's structure holds: a row none of whose units is applied stays as it is there (absent if it
    isn't there), one all of whose units are applied is the draft's, and others are merged. In the tables `restructured`
    (table_created_id), whose schema differs between the sides and isn't applied, the draft's rows don't fit as they are:
    new ones are moved into the head's structure, changed ones are merged.
    """
    mine = units.join(applied.select("key", F.lit(True).alias("on")), "key", "left")
    per = mine.groupBy("table_created_id", "row").agg(F.count("*").alias("n"), F.count("on").alias("taken"), F.max(F.col("kind") == "rowCreate").alias("created"), F.max(F.col("kind") == "rowDelete").alias("deleted"))
    differs = F.lit(False)
    if restructured is not None:
        per = per.join(restructured.select("table_created_id", F.lit(True).alias("differs")).distinct(), "table_created_id", "left")
        differs = F.coalesce("differs", F.lit(False))
    none, every = F.col("taken") == 0, F.col("taken") == F.col("n")
    outcome = F.when(none & F.col("created"), "absent").when(none, "structureSide").when(every & F.col("deleted"), "absent").when(every & F.col("created") & differs, "move")
    outcome = outcome.when(every & ~differs, "otherSide").otherwise("merge")
    return per.select("table_created_id", "row", outcome.alias("outcome"))


def table_outcomes(outcomes: DataFrame) -> DataFrame:
    """base if every row keeps the base side's link, other if every row is the other side's, else mixed."""
    kept = F.bool_and(F.col("outcome") == "structureSide")
    taken = F.bool_and(F.col("outcome").isin("otherSide", "absent"))
    return outcomes.groupBy("table_created_id").agg(F.when(kept, "base").when(taken, "other").otherwise("mixed").alias("outcome"))


def closure(selected: DataFrame, requires: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Units to apply (key) with all that they require, by edges (key, requires), and whether each `blocks`, being excluded.

    One step of the longest chain a round; every round's new units are a written table.
    """
    spark, folder = selected.sparkSession, scratch(selected.sparkSession, "closure")
    seen, new, i = None, selected.select("key").distinct(), 0
    while True:
        new.write.parquet(f"{folder}/{i}")
        new = spark.read.parquet(f"{folder}/{i}")
        if new.isEmpty():
            break
        seen, i = new if seen is None else seen.unionByName(new), i + 1
        new = new.join(requires, "key").select(F.col("requires").alias("key")).distinct().join(seen, "key", "left_anti")
    seen = new if seen is None else seen
    if excluded is None:
        return seen.withColumn("blocks", F.lit(False))
    return seen.join(excluded.select("key", F.lit(True).alias("blocks")).distinct(), "key", "left").select("key", F.coalesce("blocks", F.lit(False)).alias("blocks"))


def required_rows(units: DataFrame, pairs: DataFrame, path: str, target_table: str) -> DataFrame:
    """Edges (key, requires): a unit that brings a reference at a path into the target requires the unit that creates the
    row it refers to, if only the draft has that row."""
    made = pairs.filter((F.col("table_created_id") == target_table) & F.col("from_id").isNull())
    made = made.select(F.col("to_id").alias("target"), F.when(F.col("replaced"), F.col("row_id")).otherwise(F.col("row_created_id")).alias("row"))
    creating = units.filter((F.col("table_created_id") == target_table) & F.col("kind").isin("rowCreate", "rowReplace")).select("row", F.col("key").alias("requires"))
    held = pairs.filter("from_id is not null").select("table_created_id", F.col("from_id").alias("target"))
    held = held.filter(F.col("table_created_id") == target_table).select("target").distinct()
    wanted = made.join(creating, "row").join(held, "target", "left_anti").select("target", "requires")
    who = F.when(F.col("replaced"), F.col("row_id")).otherwise(F.col("row_created_id"))
    refs = pairs.filter("to_data is not null").select("table_created_id", who.alias("row"), F.explode(values_at("to_data", path)).alias("target"))
    bringing = units.filter(F.col("kind").isin("rowCreate", "rowReplace") | ((F.col("kind") == "field") & (F.col("path") == path)))
    return refs.join(bringing.select("table_created_id", "row", "key"), ["table_created_id", "row"]).join(wanted, "target").select("key", "requires").distinct()


def table_id_collisions(tables: DataFrame) -> DataFrame:
    """Names that more than one table (created_id, id) of a target would have."""
    return tables.select("created_id", "id").distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def merged(pairs: DataFrame, applied: DataFrame, fields: list[str]) -> DataFrame:
    """row_created_id and fields of rows on both sides: each field from the draft if its unit is applied, else the head."""
    on = applied.filter("kind = 'field'").groupBy(F.col("row").alias("row_created_id")).agg(F.collect_set("path").alias("paths"))
    rows = pairs.filter(~F.col("one_sided")).join(on, "row_created_id", "left")
    taken = lambda f: F.coalesce(F.array_contains("paths", f), F.lit(False))
    return rows.select("row_created_id", *[F.when(taken(f), F.get_json_object("to_data", f"$.{f}")).otherwise(F.get_json_object("from_data", f"$.{f}")).alias(f) for f in fields])


def merged_documents(pairs: DataFrame, applied: DataFrame, schema: dict) -> DataFrame:
    """row_created_id, data and hash of rows on both sides: each top-level field from the draft if its unit is applied, else
    from the head; values stay as they are written, computed fields are computed again."""
    names = list(schema["properties"])
    on = applied.filter("kind = 'field'").groupBy(F.col("row").alias("row_created_id")).agg(F.collect_set("path").alias("paths"))
    rows = pairs.filter(~F.col("one_sided")).join(on, "row_created_id", "left")
    kind = "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">"
    rows = rows.withColumns({"a": F.from_json("from_data", kind), "b": F.from_json("to_data", kind)})
    taken = lambda n: F.coalesce(F.array_contains("paths", n), F.lit(False))
    made = F.to_json(F.struct(*[F.when(taken(n), F.col(f"b.`{n}`")).otherwise(F.col(f"a.`{n}`")).alias(n) for n in names]))
    rows = rows.select("row_created_id", made.alias("data"))
    if Formulas.of(schema):
        typed = Formulas().compute(rows.withColumn("d", F.from_json("data", schema_type(schema))), "d", schema)
        rows = typed.select("row_created_id", F.to_json("d").alias("data"))
    return rows.withColumn("hash", F.md5("data"))


def fingerprint(units: DataFrame) -> str:
    """A digest of a set of units, whatever their order."""
    r = units.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64(F.lit(1), "key").bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return hashlib.sha256(f"{r['n']}:{r['x']}:{r['s']}".encode()).hexdigest()


def status(planned: Column, applied: Column, required: Column, blockers: Column, include_required: Column, expected: Column, actual: Column) -> Column:
    """Whether a plan can be carried out, out of its counts; without an expected fingerprint (null) none is stale."""
    stale = F.coalesce(expected != actual, F.lit(False))
    return (
        F.when(~planned, "blocked").when((applied == 0) & (blockers == 0), "empty").when(stale, "stale").when(blockers > 0, "blocked")
        .when((required > 0) & ~include_required, "required").otherwise("ready")
    )


def estimate(outcomes: DataFrame, links: DataFrame) -> DataFrame:
    """For each table: changed rows, rows to be merged and links to be copied (of mixed tables), and whether a limit is passed."""
    rows = outcomes.groupBy("table_created_id").agg(F.count("*").alias("changed_rows"), F.count_if(F.col("outcome") == "merge").alias("per_row_work"))
    out = rows.join(table_outcomes(outcomes), "table_created_id").join(links, "table_created_id", "left")
    copied = F.when(F.col("outcome") == "mixed", F.coalesce("n_links", F.lit(0))).otherwise(0).alias("mixed_links")
    out = out.select("table_created_id", "outcome", "changed_rows", "per_row_work", copied)
    too_large = F.lit(False)
    for k in ("changed_rows", "per_row_work", "mixed_links"):
        too_large = too_large | (F.sum(k).over(_all()) > LIMITS[k])
    return out.withColumn("too_large", too_large)


def target_problems(store: Store, revision_id: str, table_id: str, schema: dict, references_to: dict[str, str]) -> DataFrame:
    """What is wrong with a table of a target (kind, detail, n): documents that don't fit the schema, references (path:
    table) to rows that there aren't, and its views."""
    rows = rows_of(store, table_at(store, revision_id, table_id))
    out = rows.select(F.lit("row").alias("kind"), F.explode(violations("data", schema)).alias("detail")).groupBy("kind", "detail").agg(F.count("*").alias("n"))
    for path, target in references_to.items():
        version = table_at(store, revision_id, target)
        held = rows_of(store, version) if version else rows.limit(0)
        out = out.unionByName(dangling(rows, [steps(path)], held).select(F.lit("reference").alias("kind"), F.col("target").alias("detail"), "n"))
    saved = table_at(store, revision_id, "sys_views")
    for r in rows_of(store, saved).filter(F.col("id") == table_id).select("data").collect() if saved else []:  # one row
        wrong = [("view", p, 1) for p in problems(json.loads(r["data"]), schema)]
        out = out.unionByName(store.branch.sparkSession.createDataFrame(wrong, "kind string, detail string, n long"))
    return out


def unreproduced(entries: list[dict], held: dict[str, dict]) -> list[str]:
    """Tables whose schema isn't what the ledger gives."""
    made = {slot.names[-1]: slot for slot in replay(entries).values() if not slot.removed}
    return sorted(t for t, schema in held.items() if t not in made or made[t].schema != schema)


def repair_plan(entries: list[dict], held: dict[str, dict]) -> list[dict]:
    """Entries after which the ledger gives the held schemas: `remove` for tables that there aren't, `init` for those that
    it doesn't know, in an order that references allow, and `update` for those that differ."""
    made = {slot.names[-1]: slot.schema for slot in replay(entries).values() if not slot.removed}
    out = [{"changeType": "remove", "tableId": t} for t in reversed(backfill_order({t: {x for _, x in foreign_key_paths(made[t] or {})} for t in made})) if t not in held]
    for t in backfill_order({t: {x for _, x in foreign_key_paths(s)} for t, s in held.items()}):
        if t not in made:
            out.append({"changeType": "init", "tableId": t, "schema": held[t]})
        elif made[t] != held[t]:
            a, b = (made[t] or {}).get("properties", {}), held[t]["properties"]
            patches = [{"op": "remove", "path": f"/properties/{k}"} for k in a if k not in b]
            patches += [{"op": "replace" if k in a else "add", "path": f"/properties/{k}", "value": b[k]} for k in b if a.get(k) != b[k]]
            out.append({"changeType": "update", "tableId": t, "patches": patches})
    return out


def apply_partial(store: Store, branch_id: str, applied: DataFrame | Callable[[DataFrame], DataFrame], schema: dict, new_head: str, now: int) -> Store:
    """A commit of some units of a branch's draft, or of those chosen from all its units: a new head between the old one
    and the draft.

    A table none of whose units is applied keeps the head's version, one all of whose rows are the draft's takes the
    draft's, locked; a mixed one gets a version of its own, whose links are the head's less those of rows that change,
    with the draft's versions and merged ones. Changed rows, what is applied and what becomes of them are asked for by
    several parts of the result, so they are worked out once and written.
    """
    spark = store.branch.sparkSession
    folder = scratch(spark, "partial")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    mine = store.revision.filter(F.col("branch_id") == branch_id)
    head, draft = mine.filter("is_head").first()["id"], mine.filter("is_draft").first()["id"]
    pairs = written(reported_pairs(store, head, draft), "pairs")
    units = row_units(pairs, list(schema["properties"]))
    applied = written((applied(units) if callable(applied) else applied).select("key", "row", "kind", "path"), "applied")
    outcomes = written(row_outcomes(units, applied), "outcomes")
    of_table = {r["table_created_id"]: r["outcome"] for r in table_outcomes(outcomes).collect()}  # tables
    a = {r["created_id"]: r["version_id"] for r in tables_of(store, head, None).collect()}
    b = {r["created_id"]: r["version_id"] for r in tables_of(store, draft, None).collect()}
    mixed = {t: f"{a[t]}@{now}" for t, o in of_table.items() if o == "mixed" and t in a}
    versions = {t: mixed.get(t, b.get(t, v) if of_table.get(t) == "other" else v) for t, v in a.items()}
    who = F.when(F.col("replaced"), F.col("row_id")).otherwise(F.col("row_created_id"))
    rows = pairs.withColumn("row", who).join(outcomes, ["table_created_id", "row"]).filter(F.col("table_created_id").isin(list(mixed)))
    version_of = F.create_map(*[F.lit(x) for kv in mixed.items() for x in kv]) if mixed else F.create_map(F.lit(""), F.lit(""))
    rows = rows.withColumn("table_version_id", F.element_at(version_of, F.col("table_created_id")))
    merged_id = F.concat("from_version_id", F.lit(f"@{now}"))
    gone = rows.filter("outcome in ('otherSide', 'move', 'merge', 'absent') and from_version_id is not null").select(F.col("from_version_id").alias("row_version_id"), "table_version_id")
    come = rows.filter("outcome in ('otherSide', 'move') and to_version_id is not null").select(F.col("to_version_id").alias("row_version_id"), "table_version_id")
    come = come.unionByName(rows.filter("outcome = 'merge'").select(merged_id.alias("row_version_id"), "table_version_id"))
    copies = [(old, mixed[t]) for t, old in a.items() if t in mixed]
    kept = store.row_table.join(F.broadcast(spark.createDataFrame(copies, "table_version_id string, new_id string")), "table_version_id").select("row_version_id", F.col("new_id").alias("table_version_id"))  # one row a table
    links = store.row_table.unionByName(kept.join(gone, ["row_version_id", "table_version_id"], "left_anti")).unionByName(come)
    documents = merged_documents(pairs, applied, schema).withColumnRenamed("data", "new_data").withColumnRenamed("hash", "new_hash")
    base = store.row_version.join(rows.filter("outcome = 'merge'").select(F.col("from_version_id").alias("version_id"), "row_created_id"), "version_id").join(documents, "row_created_id")
    made = base.withColumns({"version_id": F.concat("version_id", F.lit(f"@{now}")), "data": F.col("new_data"), "hash": F.col("new_hash"), "updated_at": F.lit(now).cast("long"), "readonly": F.lit(True)})
    tables = store.table_version.join(spark.createDataFrame(copies, "version_id string, new_id string"), "version_id").withColumns({"version_id": F.col("new_id"), "readonly": F.lit(True)}).drop("new_id")
    last = store.revision.agg(F.max("sequence")).first()[0]
    here = F.col("branch_id") == branch_id
    is_draft = F.col("id") == draft
    revisions = store.revision.withColumns({"is_head": F.col("is_head") & ~here, "parent_id": F.when(is_draft, F.lit(new_head)).otherwise(F.col("parent_id")), "sequence": F.when(is_draft, F.lit(last + 2)).otherwise(F.col("sequence"))})
    opened = store.revision.filter(F.col("id") == head).withColumns({"id": F.lit(new_head), "sequence": F.lit(last + 1), "parent_id": F.lit(head), "is_head": F.lit(True), "is_start": F.lit(False), "has_changes": F.lit(False)})
    linked = spark.createDataFrame([(new_head, v) for v in versions.values()], store.revision_table.schema)
    taken = [b[t] for t, o in of_table.items() if o == "other" and t in b]
    held = store.row_table.filter(F.col("table_version_id").isin(taken)).select(F.col("row_version_id").alias("version_id")).unionByName(come.select(F.col("row_version_id").alias("version_id"))).distinct()
    locked = F.coalesce("readonly", F.lit(False))  # only other rows can be locked, so only they are compared
    others = store.row_version.filter(~locked).join(held.withColumn("held", F.lit(True)), "version_id", "left").withColumn("readonly", F.col("readonly") | F.coalesce("held", F.lit(False))).drop("held")
    lock = store.row_version.filter(locked).unionByName(others)
    return store.but(
        revision=revisions.unionByName(opened), revision_table=store.revision_table.unionByName(linked), row_table=links, row_version=lock.unionByName(made.select(*ROW_COLUMNS)),
        table_version=store.table_version.withColumn("readonly", F.col("readonly") | F.col("version_id").isin(taken)).unionByName(tables),
    )


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy()  # one row a table


def acyclic(references: dict[str, set[str]]) -> bool:
    try:
        TopologicalSorter(references).prepare()
        return True
    except CycleError:
        return False
