"""Laws that differences, pages, formulas and plans keep."""

import base64
import hashlib
import json

import pytest

from tessera.functions import formula, paging
from tessera.functions.schema import patched, violations
from tessera.functions.search import search_column
from tessera.operators import diff, draft, history, tables, versioning
from tessera.plans import planner
from tessera.sources import store as stores


@pytest.fixture(scope="module")
def graph(spark, tiny, tmp_path_factory):
    """Written and read again, as the queries over a real store would be."""
    path = str(tmp_path_factory.mktemp("store"))
    stores.write(stores.fixture(spark, tiny), path, "overwrite")
    return stores.read(spark, path)


def ids(df, column="row_created_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_no_difference_to_itself(graph):
    assert diff.row_changes(graph, "r4", "r4").isEmpty()
    assert diff.table_changes(graph, "r4", "r4").isEmpty()


def test_added_one_way_is_removed_the_other(graph):
    there, back = diff.row_changes(graph, "r3", "r4"), diff.row_changes(graph, "r4", "r3")
    assert ids(there.filter("change_type = 'ADDED'")) == ids(back.filter("change_type = 'REMOVED'"))
    assert ids(there.filter("change_type like 'RENAMED%'")) == ids(back.filter("change_type like 'RENAMED%'"))


def test_draft_pairs_agree_with_row_changes(graph):
    a = diff.row_changes(graph, "r5", "r6").select("row_created_id", "change_type")
    b = draft.reported_pairs(graph, "r5", "r6").select("row_created_id", "change_type")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_shared_versions_never_meet_their_payload(graph):
    """The plan compares links before it reads documents."""
    pairs = diff.row_pairs(graph, "r5", "r6")
    assert pairs.filter("from_version_id = to_version_id").isEmpty()


def test_keyset_pages_give_every_row_once(graph):
    from pyspark.sql import functions as F

    rows = stores.rows_of(graph, "et4").select("version_id", F.get_json_object("data", "$.type").alias("type"))
    parts = [(F.col("type"), True), (F.col("version_id"), False)]
    seen, at = [], None
    while True:
        got, more = paging.keyset_page(rows, parts, 300, at).edges()
        seen += [r["version_id"] for r in got]
        if not more:
            break
        at = [got[-1]["type"], got[-1]["version_id"]]
    assert len(seen) == len(set(seen)) == rows.count()


def test_foreign_and_broken_cursors_give_the_first_page():
    c = paging.encode_cursor([1], [{"id": "asc"}])
    assert paging.decode_cursor(c, [{"id": "asc"}]) == [1]
    assert paging.decode_cursor(c, [{"id": "desc"}]) is None and paging.decode_cursor("?!", None) is None and paging.decode_cursor(None, None) is None


def test_offset_cursor_must_be_a_number(graph):
    with pytest.raises(ValueError):
        paging.offset_page(graph.branch, [], 1, "x1")


def test_history_of_a_row_that_never_changed_is_empty(graph):
    assert history.previous_states(graph, "r5", "to", "c8").isEmpty()


def test_history_keeps_every_step(graph):
    seqs = [r[0] for r in history.previous_states(graph, "r6", "to", "c73").orderBy("introduced_seq").select("introduced_seq").collect()]
    assert seqs == [1, 2, 4][: len(seqs)] and seqs


def test_commit_then_revert_law(graph):
    after = versioning.commit(graph, "b1", "r10")
    assert diff.row_changes(after, "r6", "r10").isEmpty()
    back = versioning.revert(graph, "r5", "r6")
    assert diff.row_changes(back, "r5", "r6").isEmpty()


def test_refusals(graph):
    with pytest.raises(versioning.Refused):
        versioning.commit(graph, "b2", "x")
    with pytest.raises(versioning.Refused):
        versioning.create_branch(graph, "b9", "main", "p1", "r4")
    with pytest.raises(versioning.Refused):
        versioning.create_branch(graph, "b9", "new", "p1", "r6")
    with pytest.raises(versioning.Refused):
        versioning.delete_branch(graph, "b1")


def test_whole_selection_is_the_draft(graph):
    units = planner.row_units(draft.reported_pairs(graph, "r5", "r6"), ["cents", "customer", "priority", "status"])
    outcomes = planner.row_outcomes(units, units)
    assert outcomes.filter("outcome = 'merge' or outcome = 'structureSide'").isEmpty()
    nothing = planner.row_outcomes(units, units.limit(0))
    assert nothing.filter("outcome in ('merge', 'otherSide')").isEmpty()


@pytest.mark.parametrize("text", ["(((", "a +", "f(", "1 2", "unknown(1)"])
def test_bad_formulas(spark, text):
    with pytest.raises(formula.FormulaError):
        from pyspark.sql import functions as F

        formula.compile_node(formula.parse(text), formula.Scope(F.col("a"), F.col("a")))


def test_formula_cycles():
    with pytest.raises(formula.FormulaError):
        formula.evaluation_order({"a": "b + 1", "b": "a + 1"})


def test_formula_paths(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select struct(2.0D as a, array(1.0D, 5.0D) as v, struct(3.0D as b) as o) as d")
    out = formula.compute(df, "d", {"x": "a * o.b", "y": "v[-1] - v[0]", "z": "x / 0", "w": "z + 1", "t": "/a + a/2"}, {"z": -1.0})
    r = out.select("d.x", "d.y", "d.z", "d.w", "d.t", "formula_errors").first()
    assert (r.x, r.y, r.z, r.w, r.t, sorted(r.formula_errors)) == (6.0, 4.0, -1.0, 0.0, 3.0, ["w", "z"])
    assert F is not None


def test_violations(spark):
    schema = {"type": "object", "properties": {"n": {"type": "number"}, "s": {"type": "string", "enum": ["a"]}}, "required": ["n"], "additionalProperties": False}
    df = spark.createDataFrame([('{"n":1,"s":"a"}',), ('{"s":"b","z":1}',), ('{"n":"x"}',), ("nope",)], "data string")
    got = [sorted(r[0]) for r in df.select(violations("data", schema)).collect()]
    assert got == [[], ["document: more fields: z", "document: n is missing", "s: not in the list"], ["n: not a number"], ["not JSON"]]


def test_patches_refuse_what_is_missing():
    with pytest.raises((KeyError, ValueError)):
        patched({"type": "object", "properties": {}}, [{"op": "replace", "path": "/properties/a", "value": {"type": "string"}}])


def test_search_kinds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("red apple pie",), ("apple red",), ("pineapple",)], "t string")
    count = lambda q, k: df.filter(search_column(F.col("t"), q, k)).count()
    assert (count("red apple", "plain"), count("red apple", "phrase"), count("pine", "prefix"), count("apple & !pie", "tsquery")) == (2, 1, 1, 1)


def test_ledger_taint():
    slots = planner.replay([{"id": "1", "changeType": "remove", "tableId": "x"}])
    assert slots["x"].problems == ["1: x doesn't exist"]


def test_linear_order_of_nothing():
    assert planner.linear_order({}) == []


def test_linear_order_refuses_forks():
    with pytest.raises(ValueError):
        planner.linear_order({"a": None, "b": "a", "c": "a"})


def test_resumable_copy(spark, tmp_path):
    from tessera.streaming.copy import copy_rows, move

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(100).repartition(3).write.parquet(src)
    copy_rows(spark, src, out, ck, lambda d: d.selectExpr("id", "id * 2 as twice"))
    copy_rows(spark, src, out, ck, lambda d: d.selectExpr("id", "id * 2 as twice"))
    assert spark.read.parquet(out).count() == 100
    assert move("COPYING", "SWAPPING") == "SWAPPING"
    with pytest.raises(ValueError):
        move("SWAPPING", "CANCELLED")


ORDERS = {"type": "object", "properties": {"cents": {"type": "number"}, "customer": {"type": "string"}, "priority": {"type": "string"}, "status": {"type": "string"}}}


def test_references_follow_renames_at_their_path_only(spark):
    schema = {"type": "object", "properties": {"a": {"type": "object", "properties": {"c": {"type": "string"}, "n": {"type": "number"}}}, "l": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "string"}, "k": {"type": "string"}}}}, "c": {"type": "string"}}}
    rows = spark.createDataFrame([("v1", "r1", '{"a": {"c": "x\\"1", "n": 1.50}, "l": [{"c": "x\\"1", "k": "x"}, {"c": "y"}], "c": "x\\"1"}'), ("v2", "r2", '{"c":"y"}')], "version_id string, id string, data string")
    pairs = spark.createDataFrame([('x"1', "z")], "old_id string, new_id string")
    at = lambda path: [(r.id, json.loads(r.data)) for r in versioning.rename_cascade(rows, schema, path, pairs).collect()]
    assert at("a.c") == [("r1", {"a": {"c": "z", "n": 1.5}, "l": [{"c": 'x"1', "k": "x"}, {"c": "y"}], "c": 'x"1'})]
    assert at("l.*.c") == [("r1", {"a": {"c": 'x"1', "n": 1.5}, "l": [{"c": "z", "k": "x"}, {"c": "y"}], "c": 'x"1'})]
    assert at(["c"]) == [("r1", {"a": {"c": 'x"1', "n": 1.5}, "l": [{"c": 'x"1', "k": "x"}, {"c": "y"}], "c": "z"})]


def test_what_brings_a_reference_requires_the_row(spark):
    rows = [
        ("tc", "c1", "new", None, "new", None, '{"name":"n"}', True, False, None, 1), ("to", "o1", "made", None, "made", None, '{"customer":"new"}', True, False, None, 1),
        ("to", "o2", "old", "old", "old", '{"customer":"a"}', '{"customer":"new"}', False, False, 1, 1), ("to", "o3", "old3", "old3", "old3", '{"customer":"b"}', '{"customer":"a"}', False, False, 1, 1),
    ]
    pairs = spark.createDataFrame(rows, "table_created_id string, row_created_id string, row_id string, from_id string, to_id string, from_data string, to_data string, one_sided boolean, replaced boolean, from_published_at long, to_published_at long")
    units = planner.row_units(pairs, ["customer"])
    edges = planner.required_rows(units, pairs, "customer", "tc")
    assert {tuple(r) for r in edges.collect()} == {("to/rowCreate/o1/", "tc/rowCreate/c1/"), ("to/field/o2/customer", "tc/rowCreate/c1/")}
    chosen = planner.closure(units.filter("row = 'o2'"), edges, units.filter("row = 'c1'"))
    assert {tuple(r) for r in chosen.collect()} == {("to/field/o2/customer", False), ("tc/rowCreate/c1/", True)}
    assert planner.closure(units.limit(0), edges).count() == 0


def test_partial_commits_of_all_and_of_nothing(graph):
    units = planner.row_units(draft.reported_pairs(graph, "r5", "r6"), list(ORDERS["properties"]))
    content = lambda s, r: {tuple(x) for x in stores.revision_rows(s, r).select("table_created_id", "created_id", "id", "hash").collect()}
    whole = planner.apply_partial(graph, "b1", units, ORDERS, "r7", 90)
    assert content(whole, "r7") == content(graph, "r6")
    assert [r["id"] for r in whole.revision.filter("branch_id = 'b1' and is_head").collect()] == ["r7"]
    assert diff.row_changes(whole, "r7", "r6").isEmpty()
    assert content(planner.apply_partial(graph, "b1", units.limit(0), ORDERS, "r7", 90), "r7") == content(graph, "r5")


def test_integrity_flags(graph):
    from pyspark.sql import functions as F

    flags = lambda s: {k for k, v in history.integrity(s, "f8", "to").first().asDict().items() if v}
    assert flags(graph) == set()
    assert "gap" in flags(graph.but(revision=graph.revision.filter("id <> 'f7'")))
    assert "cycle" in flags(graph.but(revision=graph.revision.withColumn("parent_id", F.when(F.col("id") == "r1", "f8").otherwise(F.col("parent_id")))))
    assert flags(graph.but(branch=graph.branch.withColumn("project_id", F.when(F.col("id") == "b1", "p9").otherwise(F.col("project_id"))))) == {"cross_project"}
    assert "draft_in_ancestry" in flags(graph.but(revision=graph.revision.withColumn("is_draft", F.col("is_draft") | (F.col("id") == "r2"))))
    with pytest.raises(history.HistoryError):
        history.assert_integrity(graph.but(revision=graph.revision.filter("id <> 'f7'")), "f8", "to")


def test_history_cursors_are_bound(graph):
    cursor = history.row_page(graph, "r5", "to", "c73", 1).first()["cursor"]
    assert history.row_page(graph, "r5", "to", "c73", 5, cursor).filter("introduced_seq >= 5").isEmpty()
    for other in (("r6", "to", "c73"), ("r5", "tc", "c73"), ("r5", "to", "c3")):
        with pytest.raises(ValueError):
            history.row_page(graph, *other, 1, cursor)
    with pytest.raises(ValueError):
        history.row_page(graph, "r5", "to", "c73", 101)


def test_value_token(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(draft.token(F.lit("häl")).alias("t")).first()[0]
    assert got == base64.urlsafe_b64encode(hashlib.sha256("häl".encode()).digest()).decode().rstrip("=")


def test_lifecycle_refusals(graph):
    schema = {"type": "object", "properties": {}}
    for act in (
        lambda: tables.create_table(graph, "r5", "new", schema, 1), lambda: tables.create_table(graph, "r6", "orders", schema, 1), lambda: tables.create_table(graph, "r6", "1st", schema, 1),
        lambda: tables.create_table(graph, "r6", "new", {"type": "object", "properties": {"a-b": {"type": "string"}}}, 1), lambda: tables.rename_table(graph, "r6", "orders", "clients", 1), lambda: tables.rename_table(graph, "r6", "none", "other", 1),
        lambda: tables.update_table(graph, "r6", "sys_schemas", [], 1), lambda: tables.put_views(graph, "r6", "orders", {"defaultViewId": "x", "views": []}, schema, 1),
    ):
        with pytest.raises(versioning.Refused):
            act()


def test_a_created_table_takes_rows_and_is_committed(graph):
    from tessera.operators.scan import insert_rows

    after = tables.create_table(graph, "r6", "notes", {"type": "object", "properties": {"t": {"type": "string"}}}, 5)
    rows = graph.row_version.filter("version_id = 'zs-orders'")
    from pyspark.sql import functions as F

    after = insert_rows(after, rows.withColumns({"version_id": F.lit("n1"), "id": F.lit("n1"), "created_id": F.lit("cn1"), "readonly": F.lit(False)}), stores.table_at(after, "r6", "notes"))
    done = versioning.commit(after, "b1", "r10")
    changes = diff.row_changes(done, "r5", "r6").filter("to_id = 'n1'").collect()
    assert [r["change_type"] for r in changes] == ["ADDED"] and tables.schema_of(done, "r10", "notes")[1][0]["patches"][0]["op"] == "add"


def test_copies_under_leases(spark):
    from tessera.streaming import control

    rows = [("a", "r", "t", "SWAPPING", 1, 2, "w1", 10, 1, None), ("b", "r", "u", "PENDING", 0, 2, None, None, 2, None), ("c", "r", "v", "COPYING", 1, 2, "w2", 10, 3, None)]
    table = spark.createDataFrame(rows, control.SCHEMA)
    state = lambda df: {r["id"]: (r["status"], r["owner"]) for r in df.collect()}
    late = control.recover(table, 1000, 100)
    assert state(late) == {"a": ("SWAPPING", None), "b": ("PENDING", None), "c": ("CANCELLED", None)}
    assert state(control.claim(late, "w3", 1000))["a"] == ("SWAPPING", "w3")
    assert state(control.claim(table, "w1", 1000)) == state(table)
    assert control.beat(table, "w2", 50, 2).filter("id = 'c'").first()["copied_rows"] == 2
    with pytest.raises(ValueError):
        control.abort(table, "a")


def test_commutative_digest_of_a_table_whose_sum_leaves_a_bigint(spark):
    from tessera.plans.derived import commutative_digest

    n = 150_000
    got = commutative_digest(spark.range(n).selectExpr("'v' || id as row_version_id", "'t' as table_version_id")).first()
    hashes = [hashlib.md5(f"v{i}".encode()).hexdigest() for i in range(n)]
    total, digest = sum(int(h[15:27], 16) for h in hashes), 0
    for h in hashes:
        digest ^= int(h[:15], 16)
    assert total >= 1 << 63
    assert (got["n"], got["digest"], got["total"] % (1 << 64)) == (n, digest, total % (1 << 64))


def test_system_rows_change_apart_from_the_rows_of_tables(spark, graph):
    """A rename and a whole table's update send no rows of tables: the plans over system rows have no shuffle of them, and
    what was rewritten is read without a join by id."""
    renamed = tables.rename_table(graph, "f9", "orders", "sales", 1704300000000)
    rows = stores.system_rows(renamed, "f9")
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r["table_id"], r["id"]) for r in rows.collect()} >= {("sys_schemas", "sales"), ("sys_views", "sales")}
    added = [{"op": "add", "path": "/properties/note", "value": {"type": "string", "default": "n"}}]
    after = tables.update_table(graph, "r6", "orders", added, 1704300000000)
    got = stores.rows_of(after, "ot6")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner, (id#" in line]
    before = stores.rows_of(graph, "ot6")
    assert got.count() == before.count() and got.filter("readonly or data not like '%\"note\":\"n\"%'").isEmpty()
    assert sorted(r[0] for r in got.select("created_id").collect()) == sorted(r[0] for r in before.select("created_id").collect())
    assert after.row_version.filter("not readonly and id not like 'order-%' and version_id not like 'z%' and version_id not like '%/%'").isEmpty()
    assert after.row_table.filter("table_version_id = 'ot4'").count() == graph.row_table.filter("table_version_id = 'ot4'").count()


def test_removal_compares_links_in_parts_by_their_number(graph, monkeypatch):
    monkeypatch.setattr(stores, "TASK_LINKS", 100)
    plan = versioning.remove_table(graph, "r6", "ot6").row_version._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [version_id") == 2 and f", {-(-graph.row_table.count() // 100)}" in plan


def test_links_are_dealt_by_their_number(graph, monkeypatch):
    """Tasks that group or compare links get no more of them as tables grow."""
    before = history.introductions(graph, "f8", "to").collect()
    links = graph.row_table.filter("table_version_id in ('ot1', 'ot2', 'ot8')").count()
    monkeypatch.setattr(stores, "TASK_LINKS", 100)
    after = history.introductions(graph, "f8", "to")
    assert after.rdd.getNumPartitions() == -(-links // 100)
    assert sorted(before) == sorted(after.collect()) and before


def test_partial_commit_works_changed_rows_out_once(graph):
    """The new head's rows read what was written, and no plan of theirs pairs the revisions again."""
    from tessera.plans import transitions as t

    applied = planner.select(t.units(graph), [{"kind": ["field", "rowDelete"]}])
    after = planner.apply_partial(graph, "b1", applied, t.ORDERS, "r7", 79)
    version = stores.table_at(after, "r7", "orders")
    rows = stores.rows_of(after, version).select("created_id", "data")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" not in plan and "any_value" not in plan
    opened = after.row_version.join(stores.links_of(after, "ot6"), "version_id", "left_semi").filter("not readonly")
    chosen = planner.apply_partial(graph, "b1", lambda u: planner.select(u, [{"kind": ["field", "rowDelete"]}]), t.ORDERS, "r7", 79)
    again = stores.rows_of(chosen, version).select("created_id", "data")
    assert rows.exceptAll(again).isEmpty() and again.exceptAll(rows).isEmpty()
    assert not rows.isEmpty() and opened.count() < graph.row_version.filter("not readonly").count()
