from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opsloom.operators import digest
from opsloom.plans import diagnostics as D
from opsloom.sources import page_dump, showplan, workspace


def rows(df):
    return [r.asDict() for r in df.collect()]


OBJECTS = "object_id int, schema_name string, name string, type_desc string, is_ms_shipped boolean, modify_date timestamp"
NOW = datetime(2026, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def objects(spark):
    data = [(1, "dbo", "Orders", "USER_TABLE", False), (2, "dbo", "p_Orders", "SQL_STORED_PROCEDURE", False), (3, "dbo", "t1", "SQL_TRIGGER", False), (4, "sys", "hidden", "VIEW", True), (5, "dbo", "v", "VIEW", False), (6, "dbo", "IndexOptimize", "SQL_STORED_PROCEDURE", False)]
    return spark.createDataFrame([(*r, NOW) for r in data], OBJECTS)


@pytest.fixture(scope="module")
def modules(spark):
    data = [(2, "select 1 from ORDERS", False), (3, "set nocount on; rollback; select @x = a from inserted", False), (4, "orders", False), (5, "select x_y from t", True), (6, "a --// Version: 2022-12-03 17:23:44 x", False)]
    return spark.createDataFrame(data, "object_id int, definition string, is_schema_bound boolean")


def test_tables_largest(spark):
    ps = spark.createDataFrame([(1, 0, 1, 10, 128, 100, 50, 1, 0), (1, 0, 2, 5, 128, 100, 50, 0, 0), (1, 2, 1, 15, 64, 60, 9, 0, 0), (2, 1, 1, 7, 8, 8, 8, 0, 0), (3, 1, 1, 9, 999, 9, 9, 0, 0)], "object_id int, index_id int, partition_number int, row_count long, reserved_page_count long, used_page_count long, in_row_data_page_count long, lob_used_page_count long, row_overflow_used_page_count long")
    t = spark.createDataFrame([(1, "dbo", "a", False), (2, "dbo", "b", False), (3, "sys", "c", True)], "object_id int, schema_name string, name string, is_ms_shipped boolean")
    out = rows(D.tables_largest(ps, t))
    assert [r["table_name"] for r in out] == ["a", "b"]
    assert (out[0]["row_count"], out[0]["index_count"], out[0]["partition_count"], float(out[0]["reserved_mb"]), float(out[0]["in_row_mb"])) == (15, 2, 2, 2.5, 0.78)


def test_agent_jobs(spark):
    jobs = spark.createDataFrame([(1, "b", 1, "sa"), (2, "a", 0, "x"), (3, "c", 1, "x")], "job_id int, name string, enabled int, owner string")
    servers = spark.createDataFrame([(1, 1, 20260102, 30405, 12345), (2, 0, 0, 0, 0)], "job_id int, last_run_outcome int, last_run_date int, last_run_time int, last_run_duration int")
    history = spark.createDataFrame([(1, 0, 20260102, 5, 1, "old"), (1, 0, 20260102, 5, 2, "new"), (1, 1, 20270101, 5, 3, "step")], "job_id int, step_id int, run_date int, run_time int, instance_id int, message string")
    sched = spark.createDataFrame([(1, 20260203, 1), (1, 20260202, 235959), (1, 0, 0)], "job_id int, next_run_date int, next_run_time int")
    act = spark.createDataFrame([(1, 7, NOW, None), (2, 6, NOW, None)], "job_id int, session_id int, start_execution_date timestamp, stop_execution_date timestamp")
    ses = spark.createDataFrame([(6,), (7,)], "session_id int")
    out = rows(D.agent_jobs(jobs, servers, history, sched, act, ses))
    assert [r["job_name"] for r in out] == ["a", "b", "c"]
    a, b, c = out
    assert (a["last_outcome"], a["never_run"], a["is_running"], a["last_run"]) == ("failed", True, False, None)
    assert (b["last_run"], b["last_duration_s"], b["last_message"], b["is_running"], b["next_run"], b["schedule_count"]) == ("2026-01-02T03:04:05", 5025, "new", True, "2026-02-02T23:59:59", 3)
    assert (c["last_outcome"], c["never_run"], c["schedule_count"]) == ("unknown", True, 0)


def test_backup_history(spark):
    t = lambda d, h: datetime(2026, 1, d, h)
    b = spark.createDataFrame([(1, "db", 10, t(1, 1), t(1, 2), "D", False, False, 1048576, 524288), (2, "db", 11, t(20, 1), t(20, 2), "L", False, True, 0, 0), (3, "other", 12, t(20, 1), t(20, 2), "D", False, False, 1, 1)], "backup_set_id int, database_name string, media_set_id int, backup_start_date timestamp, backup_finish_date timestamp, type string, is_snapshot boolean, is_copy_only boolean, backup_size long, compressed_backup_size long")
    m = spark.createDataFrame([(11, 1, 0, 2, "f1"), (11, 2, 0, 2, "f2"), (11, 1, 1, 2, "m")], "media_set_id int, family_sequence_number int, mirror int, device_type int, physical_device_name string")
    out = rows(D.backup_history(b, m, "db", 7, "2026-01-21"))
    assert len(out) == 1 and (out[0]["stripe_count"], out[0]["physical_device_name"], out[0]["duration_s"], out[0]["backup_start"]) == (2, "f1", 3600, "2026-01-20T01:00:00")
    assert len(rows(D.backup_history(b, m, "db", 30, "2026-01-21"))) == 2
    for name, days in (("db", 0), ("none", 7)):
        with pytest.raises(D.NotFound):
            D.backup_history(b, m, name, days, "2026-01-21")


def test_databases_nonconforming(spark):
    d = spark.createDataFrame([("a", 5, "ONLINE", 0), ("m", 1, "ONLINE", 60)], "name string, database_id int, state_desc string, target_recovery_time_in_seconds int")
    f = spark.createDataFrame([(5, "f", "ROWS", 1024, 10, True), (1, "g", "LOG", 8, 64, False), (1, "h", "LOG", 8, 0, True)], "database_id int, name string, type_desc string, size int, growth int, is_percent_growth boolean")
    out = rows(D.databases_nonconforming(d, f))
    assert [(r["finding"], r["growth_pct"], r["is_system"]) for r in out] == [("percent_growth", 10, False), ("target_recovery_time_0", None, False)]
    with pytest.raises(D.NotFound):
        D.databases_nonconforming(d, f.limit(0))


def test_object_queries(spark, objects, modules):
    deps = spark.createDataFrame([(2, 1, "Orders"), (5, None, "Orders"), (5, None, "gone"), (5, 9, "syn")], "referencing_id int, referenced_id int, referenced_entity_name string")
    out = rows(D.object_references(objects, modules, deps, 1, "Orders"))
    assert [(r["source"], r["referencing_name"]) for r in out] == [("declared", "p_Orders"), ("declared", "v"), ("text_match", "p_Orders")]
    assert rows(D.object_references(objects, modules, deps, None, "x_y"))[0]["referencing_name"] == "v"
    assert rows(D.object_references(objects, modules, deps, None, "x%y")) == []
    params = spark.createDataFrame([(2, 2, "@b", "int", True), (2, 1, "@a", "int", False), (2, 0, "", "int", True)], "object_id int, parameter_id int, name string, type_name string, is_output boolean")
    assert rows(D.proc_source(objects, modules, params, 2))[0]["parameters"] == "@a int, @b int OUTPUT"
    assert rows(D.proc_source(objects, modules, params, 5))[0]["parameters"] is None
    trig = spark.createDataFrame([(3, 1, 1, "t1", False, True), (4, 1, 0, "x", False, False)], "object_id int, parent_id int, parent_class int, name string, is_disabled boolean, is_instead_of_trigger boolean")
    (t,) = rows(D.triggers_inventory(trig, objects, modules))
    assert (t["parent_object"], t["sets_nocount"], t["has_rollback"], t["scalar_from_inserted"], t["has_cursor"]) == ("Orders", 1, 1, 1, 0)
    (v,) = rows(D.view_diagnose(objects.where("type_desc = 'VIEW'"), modules, deps, spark.createDataFrame([(9,)], "object_id int"), 5))
    assert (v["synonyms_referenced"], v["unresolved_references"]) == (1, 2)
    assert rows(D.solution_versions(objects, modules))[0]["version"] == "2022-12-03 17:23:44"
    assert rows(D.solution_versions(objects.limit(0), modules)) == [{"schema_name": None, "object_name": None, "type_desc": None, "version": None}]


def test_cpu_topology(spark):
    s = spark.createDataFrame([("Developer", 8)], "edition string, cpu_count int")
    n = spark.createDataFrame([("ONLINE",), ("OFFLINE",)], "node_state_desc string")
    sch = spark.createDataFrame([("VISIBLE ONLINE",)] * 3 + [("HIDDEN",)], "status string")
    c = spark.createDataFrame([("max degree of parallelism", 4)], "name string, value_in_use long")
    assert rows(D.cpu_topology(s, n, sch, c)) == [{"edition": "Developer", "cpu_count": 8, "numa_nodes": 1, "schedulers_online": 3, "schedulers_offline": 0, "maxdop": 4, "cost_threshold": None, "affinity_mask": None}]


def test_maintenance(spark):
    r = spark.createDataFrame([(50, "BACKUP DATABASE", "running", NOW, 12.34, "w", 5, 51), (51, "SELECT", "running", NOW, 0.0, None, 0, 0), (52, "SELECT", "x", NOW, 1.0, None, 0, 50), (53, "DBCC", "x", NOW, 0.0, None, 0, 99)], "session_id int, command string, status string, start_time timestamp, percent_complete double, wait_type string, wait_time long, blocking_session_id int")
    s = spark.createDataFrame([(i, "sleeping", f"u{i}", i) for i in (50, 51, 52, 53, 99)], "session_id int, status string, login_name string, open_transaction_count int")
    out = rows(D.maintenance_in_progress(r, s, "2026-01-02 03:05:05", 52))
    assert [r["session_id"] for r in out] == [50, 53]
    assert (out[0]["blocker_command"], out[0]["blocks_count"], out[0]["elapsed_s"]) == ("SELECT", 1, 60)
    assert (out[1]["blocker_command"], out[1]["blocker_open_transactions"]) == (None, 99)


def test_index_queries(spark):
    i = spark.createDataFrame([(1, 1, "pk", "CLUSTERED", True), (1, 2, "ix", "NONCLUSTERED", False)], "object_id int, index_id int, name string, type_desc string, is_unique boolean")
    c = spark.createDataFrame([(1, 1, "a", False, False, 1, 1), (1, 2, "c", False, True, 2, 2), (1, 2, "b", False, False, 1, 1), (1, 2, "z", True, False, 0, 3)], "object_id int, index_id int, column_name string, is_included_column boolean, is_descending_key boolean, key_ordinal int, index_column_id int")
    u = spark.createDataFrame([(1, 1, 3, 2, 1, 9, NOW, None, None)], "object_id int, index_id int, user_seeks long, user_scans long, user_lookups long, user_updates long, last_user_seek timestamp, last_user_scan timestamp, last_user_lookup timestamp")
    p = spark.createDataFrame([(1, 1, 5, 128), (1, 1, 5, 128)], "object_id int, index_id int, row_count long, used_page_count long")
    out = {r["name"]: r for r in rows(D.index_usage(i, c, u, p))}
    assert (out["pk"]["reads"], out["pk"]["row_count"], float(out["pk"]["used_mb"])) == (6, 10, 2.0)
    assert (out["ix"]["key_columns"], out["ix"]["included_columns"], out["ix"]["reads"]) == ("b, c DESC", "z", None)
    d = spark.createDataFrame([(g, 1 + g % 4, "[a]", None, "[b]") for g in range(40)], "group_handle int, object_id int, equality_columns string, inequality_columns string, included_columns string")
    st = spark.createDataFrame([(g, 1.0 + g, 50.0, 3, 1) for g in range(40)], "group_handle int, avg_total_user_cost double, avg_user_impact double, user_seeks long, user_scans long")
    ix = spark.createDataFrame([(t, n, f"k{n}") for t in (3, 4) for n in range(20)], "object_id int, index_id int, key_columns string")
    got = rows(D.missing_indexes(d, st, ix))
    assert len(got) == 3 + 24 + 30 and [r["object_id"] for r in got if r["row_kind"] == "table"] == [4, 3, 2]
    assert [r["seq"] for r in got if r["rank"] == 1 and r["row_kind"] == "missing"] == list(range(1, 9))


def test_blocked_processes_check(spark):
    s = spark.createDataFrame([(1, "good", True), (2, "off", False), (3, "odd", None), (4, "none", True)], "session_id int, name string, is_running boolean")
    e = spark.createDataFrame([(1, "blocked_process_report"), (2, "blocked_process_report"), (3, "blocked_process_report"), (4, "other")], "session_id int, event_name string")
    t = spark.createDataFrame([(1, "ring_buffer"), (1, "event_file"), (2, "event_file"), (3, "event_file")], "session_id int, target_name string")
    c = spark.createDataFrame([("blocked process threshold (s)", 5)], "name string, value_in_use long")
    assert [(r["session_name"], r["verdict"]) for r in rows(D.blocked_processes_check(s, e, t, c))] == [("good", "OK"), ("odd", "UNKNOWN"), ("off", "NOT_OK")]
    assert rows(D.blocked_processes_check(s, e, t, c.limit(0)))[0]["verdict"] == "UNKNOWN"
    assert [r["reason"] for r in rows(D.blocked_processes_check(s, e.limit(0), t, c))] == ["no session catches the event"]


DUMP = """header
Slot 0 Offset 0x60 Length 24
Record Type = PRIMARY_RECORD        Record Attributes =  NULL_BITMAP
Record Size = 24
Memory Dump @0x0000000A22836060
0000000000000000:   30001500 5a010000 4e006f00 6d002000  0...Z...N.o.m. .
0000000000000010:   636166e9 ff                          caf
Slot 0 Column 1 Offset 0x4 Length 4 Length (physical) 4
Id = 346
Slot 0 Offset 0x0 Length 0
Slot 0 Column 2 Offset 0x8 Length 8 Length (physical) 8
Nom = Nom
Slot 0 Column 3 Offset 0x10 Length 4 Length (physical) 4
Ville = caf?
Note = [BLOB Inline Data] Slot 0 Column 4 Offset 0x14 Length 4 Length (physical) 4
0000000F3C15C040:   7878  xx
Slot 0 Column 5 Offset 0x0 Length 0 Length (physical) 0
Empty = [NULL]
Slot 1 Offset 0x90 Length 9
Record Type = GHOST_DATA_RECORD
Slot 1 Column 1 Offset 0x4 Length 4 Length (physical) 4
Id = INVALID COLUMN VALUE
""".split("\n")


def test_page_dump(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(DUMP)], "file string, line_no long, line string")
    recs = page_dump.records(lines)
    vals = page_dump.values(recs, {"Nom": "nvarchar", "Ville": "varchar"})
    got = {(r["rec"], r["name"]): (r["value"], r["problem"]) for r in rows(vals)}
    assert got[(1, "Id")] == ("346", None) and got[(1, "Nom")] == ("Nom ", None) and got[(1, "Ville")] == ("café", None)
    assert got[(1, "Note")] == ("ÿ", "short") and got[(1, "Empty")] == (None, None) and got[(2, "Id")] == (None, "invalid")
    status = {r["slot"]: r["status"] for r in rows(page_dump.statuses(recs, vals))}
    assert status == {0: "short:Note", 1: "record-type,invalid:Id"}
    assert {r["slot"]: r["length"] for r in rows(recs)} == {0: 24, 1: 9}


PLAN = """<ShowPlanXML xmlns="http://x"><StmtSimple><QueryPlan><RelOp PhysicalOp="Nested Loops" EstimatedTotalSubtreeCost="1.0" EstimateRows="3"><OutputList><ColumnReference Column="a"/></OutputList><NestedLoops>
<RelOp PhysicalOp="Index Seek" EstimatedTotalSubtreeCost="0.25" EstimateRows="3"><OutputList/><IndexScan><Object Table="[T]" Index="[ix]"/></IndexScan></RelOp>
<RelOp PhysicalOp="Key Lookup" EstimatedTotalSubtreeCost="0.5" EstimateRows="1"><OutputList/><IndexScan><Object Table="[T]" Index="[pk]"/></IndexScan></RelOp></NestedLoops></RelOp></QueryPlan></StmtSimple></ShowPlanXML>"""


def test_plans(spark):
    plans = spark.createDataFrame([(1, PLAN), (2, "no xml <"), (3, None)], "plan_id long, xml string")
    nodes = showplan.read_plans(plans)
    assert [(r["node"], r["parent"], r["depth"], r["op"], r["cost"], r["columns"]) for r in rows(nodes.orderBy("node"))] == [(0, -1, 0, "Nested Loops", 0.25, ["a"]), (1, 0, 1, "Index Seek", 0.25, []), (2, 0, 1, "Key Lookup", 0.5, [])]
    assert rows(showplan.shapes(nodes))[0]["shape"] == "Nested Loops|Index Seek(T.ix)|Key Lookup(T.pk)"
    assert rows(showplan.lookups(nodes))[0]["index_name"] == "ix"


def test_workspace(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"seq":1,"kind":"i","name":"a","state":"created"}\n{"seq":2,"kind":"i","na')
    good, bad = workspace.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert good.count() == 1 and bad.count() == 1
    assert workspace.strict_rows('{"rows":[{"a":1},{"a":null}]}', ["a"]) == ([{"a": 1}], [({"a": None}, "a is missing")])
    for text in ('{"rows":[{"a":1,"x":2}]}', '{"rows":[]} 1', '{"other":1}'):
        with pytest.raises(ValueError):
            workspace.strict_rows(text, ["a"])
    assert '"rowcount": 9, "truncated": true' in workspace.envelope(spark.range(9), 2)
    assert '"ok": false' in workspace.error_envelope(ValueError("x"))
    workspace.write_tsv(spark.createDataFrame([("a\tb", None), ("c\\", 1)], "x string, y int").coalesce(1), str(tmp_path / "t"))
    assert sorted("".join(f.read_text() for f in (tmp_path / "t").glob("part-*")).splitlines()) == ["a\\tb\t\\N", "c\\\\\t1"]
    df = spark.createDataFrame([(1, "job 1", "s1"), (2, "job 2", "s2"), (3, "once\nlines", "s")], "seq long, text string, source string").withColumn("time", F.lit("t"))
    told = workspace.text_digest(digest.roll_up(df), {"total": 3, "kept": 3, "dropped": 0})
    assert told == "entries 3, kept 3, dropped 0\n\n[x2] t - t  job 1\nonce\n  lines\n"
