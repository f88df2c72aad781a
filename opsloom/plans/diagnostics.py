"""Diagnostic queries over snapshots of a server's system views.

Each function takes the snapshots it reads as DataFrames (columns as in FIXTURES.md) and returns the report's rows. Where
a report has a limit, the limit is the feature; ties are broken by a unique key so that results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.scalar import int_time_seconds, seconds_between
from opsloom.operators.bounded import or_sentinel


class NotFound(ValueError):
    """The object or the permission that a report needs is missing; an empty result would mislead."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise NotFound(message)


def _mb(pages: Column) -> Column:
    return (pages * F.lit(8.0) / 1024).cast("decimal(18,2)")


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _int_stamp(date: Column, time: Column) -> Column:
    """``yyyymmdd`` and ``hhmmss`` integers as ISO text; null without a date."""
    text = F.concat(date.cast("string"), F.lpad(time.cast("string"), 6, "0"))
    return F.when(date > 0, F.regexp_replace(text, "^(\\d{4})(\\d\\d)(\\d\\d)(\\d\\d)(\\d\\d)(\\d\\d)$", "$1-$2-$3T$4:$5:$6"))


def tables_largest(partition_stats: DataFrame, tables: DataFrame, most: int = 50) -> DataFrame:
    """User tables by reserved space. Partitions are summed by index first: the distinct count needs no second pass."""
    base = F.col("index_id").isin(0, 1)
    by_index = partition_stats.groupBy("object_id", "index_id").agg(
        *[F.sum(c).alias(c) for c in ("row_count", "reserved_page_count", "used_page_count", "in_row_data_page_count", "lob_used_page_count", "row_overflow_used_page_count")],
        F.max("partition_number").alias("partition_number"),
    )
    named = by_index.join(tables.where("not is_ms_shipped").select("object_id", "schema_name", F.col("name").alias("table_name")), "object_id")
    out = named.groupBy("schema_name", "table_name").agg(
        F.sum(F.when(base, F.col("row_count")).otherwise(0)).alias("row_count"),
        F.sum("reserved_page_count").alias("__reserved"),
        _mb(F.sum("used_page_count")).alias("used_mb"),
        _mb(F.sum(F.when(base, F.col("in_row_data_page_count")).otherwise(0))).alias("in_row_mb"),
        _mb(F.sum("lob_used_page_count")).alias("lob_mb"),
        _mb(F.sum("row_overflow_used_page_count")).alias("row_overflow_mb"),
        F.count("index_id").alias("index_count"),
        F.max("partition_number").alias("partition_count"),
    )
    return out.orderBy(F.desc("__reserved"), "schema_name", "table_name").limit(most).withColumn("reserved_mb", _mb(F.col("__reserved"))).drop("__reserved")


def agent_jobs(jobs: DataFrame, servers: DataFrame, history: DataFrame, schedules: DataFrame, activity: DataFrame, sessions: DataFrame, most: int = 300) -> DataFrame:
    """Jobs with last outcome, last message, next run and whether they run now; failed ones first."""
    last = history.where("step_id = 0").groupBy("job_id").agg(F.max_by("message", F.struct("run_date", "run_time", "instance_id")).alias("message"))
    runs = schedules.where("next_run_date > 0").groupBy("job_id").agg(F.min(F.struct("next_run_date", "next_run_time")).alias("next"))
    times = schedules.groupBy("job_id").agg(F.count("*").alias("schedule_count"))
    now = sessions.agg(F.max("session_id").alias("session_id"))
    running = activity.where("start_execution_date is not null and stop_execution_date is null").join(F.broadcast(now), "session_id").select("job_id").distinct().withColumn("is_running", F.lit(True))
    outcome = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in enumerate(("failed", "succeeded", "retry", "canceled", "in progress")) for x in p]), F.col("last_run_outcome").cast("int")), F.lit("unknown"))
    out = jobs.join(servers, "job_id", "left")
    for other in (last, runs, times, running):
        out = out.join(other, "job_id", "left")
    first = F.when(F.col("last_run_outcome") == 0, 0).otherwise(1)
    return out.orderBy(first, "name", "job_id").limit(most).select(
        F.col("name").alias("job_name"), F.col("enabled").cast("boolean").alias("is_enabled"), "owner", outcome.alias("last_outcome"),
        (F.coalesce("last_run_date", F.lit(0)) == 0).alias("never_run"), _int_stamp(F.col("last_run_date"), F.col("last_run_time")).alias("last_run"),
        int_time_seconds(F.col("last_run_duration")).cast("long").alias("last_duration_s"), F.left("message", F.lit(400)).alias("last_message"), F.coalesce("is_running", F.lit(False)).alias("is_running"),
        _int_stamp(F.col("next.next_run_date"), F.col("next.next_run_time")).alias("next_run"), F.coalesce("schedule_count", F.lit(0)).alias("schedule_count"),
    )


def backup_history(backups: DataFrame, media: DataFrame, name: str, days: int, as_of: str, most: int = 500) -> DataFrame:
    """Backups of a database in the last ``days`` days before ``as_of``, the newest first."""
    _require(1 <= days <= 366, "days must be a whole number from 1 to 366")
    own = backups.where(F.col("database_name") == name)
    _require(not own.isEmpty(), f"no backup of a database named {name}")
    stripes = media.where("mirror = 0").groupBy("media_set_id").agg(F.count("*").alias("stripe_count"))
    first = media.where("family_sequence_number = 1 and mirror = 0").select("media_set_id", "device_type", "physical_device_name")
    size = lambda c: (F.col(c) / 1048576.0).cast("decimal(18,1)")
    start = F.col("backup_start_date")
    inside = own.where(start >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    rows = inside.join(first, "media_set_id", "left").join(stripes, "media_set_id", "left").orderBy(F.desc("backup_start_date"), "backup_set_id").limit(most)
    return rows.select(
        "database_name", _iso("backup_start_date").alias("backup_start"), _iso("backup_finish_date").alias("backup_finish"), seconds_between(start, F.col("backup_finish_date")).alias("duration_s"),
        F.col("type").alias("backup_type"), "is_snapshot", "is_copy_only", size("backup_size").alias("size_mb"), size("compressed_backup_size").alias("compressed_mb"),
        "device_type", "physical_device_name", F.coalesce("stripe_count", F.lit(0)).alias("stripe_count"),
    )


def databases_nonconforming(databases: DataFrame, files: DataFrame, most: int = 500) -> DataFrame:
    """Findings by database: no target recovery time, and files that grow by per cent."""
    _require(not files.isEmpty(), "no file can be seen; the growth check cannot be made")
    d = databases.select(F.col("name").alias("database_name"), "database_id", (F.col("database_id") <= 4).alias("is_system"), "state_desc", "target_recovery_time_in_seconds")
    none = {"file_name": "string", "file_type": "string", "size_mb": "decimal(18,1)", "growth_pct": "int"}
    recovery = d.where("target_recovery_time_in_seconds = 0").select("*", F.lit("target_recovery_time_0").alias("finding"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    grown = files.where("is_percent_growth and growth > 0").select("database_id", F.lit("percent_growth").alias("finding"), F.col("name").alias("file_name"), F.col("type_desc").alias("file_type"), (F.col("size") * 8 / 1024.0).cast("decimal(18,1)").alias("size_mb"), F.col("growth").cast("int").alias("growth_pct"))
    return recovery.unionByName(d.join(grown, "database_id")).drop("database_id").orderBy("database_name", "finding", "file_name").limit(most)


def object_references(objects: DataFrame, modules: DataFrame, dependencies: DataFrame, object_id: int | None, bare_name: str) -> DataFrame:
    """What refers to an object: declared dependencies, and user modules whose text names it literally, in any case."""
    d = F.col("referenced_id").isNull() & (F.col("referenced_entity_name") == bare_name)
    declared = dependencies.where(d if object_id is None else d | (F.col("referenced_id") == object_id)).select(F.col("referencing_id").alias("object_id"), F.lit("declared").alias("source"))
    named = modules.where(F.contains(F.lower("definition"), F.lit(bare_name.lower()))).select("object_id", F.lit("text_match").alias("source"))
    found = declared.union(named).distinct().join(objects.select("object_id", "schema_name", "name", "type_desc", "is_ms_shipped"), "object_id").where("source = 'declared' or not is_ms_shipped")
    return found.select("source", F.col("schema_name").alias("referencing_schema"), F.col("name").alias("referencing_name"), F.col("type_desc").alias("referencing_type")).distinct().orderBy("source", "referencing_schema", "referencing_name")


def proc_source(objects: DataFrame, modules: DataFrame, parameters: DataFrame, object_id: int) -> DataFrame:
    """A module's definition with its parameters as one text."""
    one = F.concat("name", F.lit(" "), "type_name", F.when(F.col("is_output"), " OUTPUT").otherwise(""))
    listed = parameters.where((F.col("object_id") == object_id) & (F.col("parameter_id") > 0)).groupBy("object_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("parameter_id", one.alias("t"))))["t"], ", ").alias("parameters"))
    return objects.where(F.col("object_id") == object_id).join(modules.select("object_id", "definition"), "object_id").join(listed, "object_id", "left").select("schema_name", F.col("name").alias("object_name"), "type_desc", "parameters", "definition")


# Texts that read one row's value from a trigger's row sets.
SCALAR_READS = ("%=%(SELECT%inserted%", "%=%(SELECT%deleted%", "%SELECT%@%=%FROM%inserted%", "%SELECT%@%=%FROM%deleted%")


def triggers_inventory(triggers: DataFrame, objects: DataFrame, modules: DataFrame) -> DataFrame:
    """DML triggers with hints on what their text does (0/1)."""
    has = lambda *patterns: F.when(_any([F.col("definition").ilike(p) for p in patterns]), 1).otherwise(0)
    o = objects.select("object_id", F.col("schema_name").alias("trigger_schema"), "modify_date", "is_ms_shipped")
    parent = objects.select(F.col("object_id").alias("parent_id"), F.col("schema_name").alias("parent_schema"), F.col("name").alias("parent_object"))
    rows = triggers.where("parent_class = 1").join(o, "object_id").where("not is_ms_shipped").join(modules.select("object_id", "definition"), "object_id").join(parent, "parent_id", "left")
    return rows.select(
        "parent_schema", "parent_object", "trigger_schema", F.col("name").alias("trigger_name"), "is_disabled", "is_instead_of_trigger", "modify_date", has("%NOCOUNT%").alias("sets_nocount"), has("%@@ROWCOUNT%").alias("reads_rowcount"),
        has(*SCALAR_READS).alias("scalar_from_inserted"), has("%CURSOR%").alias("has_cursor"), has("%ROLLBACK%").alias("has_rollback"), has("%BEGIN TRAN%").alias("has_transaction"), F.length(F.rtrim("definition")).alias("definition_length"),
    ).orderBy("parent_schema", "parent_object", "trigger_name")


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def view_diagnose(views: DataFrame, modules: DataFrame, dependencies: DataFrame, synonyms: DataFrame, object_id: int) -> DataFrame:
    """A view with how many synonyms it refers to and how many of its references resolve to nothing."""
    own = dependencies.where(F.col("referencing_id") == object_id)
    through = own.join(synonyms.select(F.col("object_id").alias("referenced_id")), "referenced_id").agg(F.count("*").alias("synonyms_referenced"))
    loose = own.where("referenced_id is null").agg(F.count("*").alias("unresolved_references"))
    view = views.where(F.col("object_id") == object_id).join(modules.select("object_id", "is_schema_bound", "definition"), "object_id")
    return view.join(F.broadcast(through)).join(F.broadcast(loose)).select("schema_name", F.col("name").alias("view_name"), "is_schema_bound", "synonyms_referenced", "unresolved_references", "definition")


def cpu_topology(system: DataFrame, nodes: DataFrame, schedulers: DataFrame, configurations: DataFrame) -> DataFrame:
    """One row of processor facts; a setting that is not there is null."""
    count = lambda df, c, v, n: df.agg(F.count_if(F.col(c) == v).alias(n))
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value_in_use")))
    settings = configurations.agg(value("max degree of parallelism").cast("int").alias("maxdop"), value("cost threshold for parallelism").cast("int").alias("cost_threshold"), value("affinity mask").cast("long").alias("affinity_mask"))
    out = system.limit(1)
    for one in (count(nodes, "node_state_desc", "ONLINE", "numa_nodes"), count(schedulers, "status", "VISIBLE ONLINE", "schedulers_online"), count(schedulers, "status", "VISIBLE OFFLINE", "schedulers_offline"), settings):
        out = out.join(F.broadcast(one))
    return out


#: Commands that maintenance runs.
MAINTENANCE = ("BACKUP%", "RESTORE%", "ALTER%", "DBCC%", "CREATE INDEX%")


def maintenance_in_progress(requests: DataFrame, sessions: DataFrame, as_of: str, own_session: int, most: int = 100) -> DataFrame:
    """Maintenance requests with what blocks them and how many they block.

    The first ``most`` are taken before the left joins, which lose no row: most requests are blocked by none, and their
    null keys would meet in one task. Should a blocker have several rows, the same order bounds the result once more.
    """
    r = requests.withColumn("blocked_by", F.nullif("blocking_session_id", F.lit(0)))
    blocks = r.where("blocked_by is not null").groupBy(F.col("blocked_by").alias("session_id")).agg(F.count("*").alias("blocks_count"))
    by_request = requests.select(F.col("session_id").alias("blocked_by"), F.col("command").alias("blocker_command"), F.col("wait_type").alias("blocker_wait_type"))
    by_session = sessions.select(F.col("session_id").alias("blocked_by"), F.col("status").alias("blocker_status"), F.col("open_transaction_count").alias("blocker_open_transactions"))
    c = F.col("command")
    wanted = _any([c.like(p) for p in MAINTENANCE]) | (c == "KILLED/ROLLBACK") | (F.col("percent_complete") > 0)
    rows = r.where((F.col("session_id") != own_session) & wanted).join(sessions.select("session_id", "login_name"), "session_id")
    rows = rows.orderBy("start_time", "session_id").limit(most)
    rows = rows.join(by_session, "blocked_by", "left").join(by_request, "blocked_by", "left").join(blocks, "session_id", "left").orderBy("start_time", "session_id").limit(most)
    return rows.select(
        "session_id", "command", "status", _iso("start_time").alias("started"), seconds_between(F.col("start_time"), F.lit(as_of).cast("timestamp")).alias("elapsed_s"), F.col("percent_complete").cast("decimal(5,1)").alias("percent_complete"),
        "wait_type", F.col("wait_time").alias("wait_ms"), F.col("blocked_by").alias("blocking_session_id"), "blocker_command", "blocker_status", "blocker_wait_type", "blocker_open_transactions", F.coalesce("blocks_count", F.lit(0)).alias("blocks_count"), "login_name",
    )


# The procedures and tables of the public maintenance solution, and what stands before its version.
SOLUTION = ("CommandExecute", "DatabaseBackup", "DatabaseIntegrityCheck", "IndexOptimize", "CommandLog", "Queue", "QueueDatabase")
VERSION_MARK = "--// Version: "


def solution_versions(objects: DataFrame, modules: DataFrame, most: int = 20) -> DataFrame:
    """The maintenance solution's objects with their versions; one row of nulls where there are none."""
    at = F.locate(VERSION_MARK, F.col("definition"))
    found = objects.where(F.col("name").isin(*SOLUTION) & ~F.col("is_ms_shipped")).join(modules.select("object_id", "definition"), "object_id", "left")
    out = found.select("schema_name", F.col("name").alias("object_name"), "type_desc", F.when(at > 0, F.substring("definition", at + len(VERSION_MARK), F.lit(19))).alias("version"))
    return or_sentinel(out).orderBy("type_desc", "object_name").limit(most)


def index_usage(indexes: DataFrame, columns: DataFrame, usage: DataFrame, partitions: DataFrame) -> DataFrame:
    """Indexes with keys and includes as texts, sizes and use; no counters are null, which is not 0."""
    listed = lambda included: F.array_join(
        F.sort_array(F.collect_list(F.when(F.col("is_included_column") == included, F.struct("ordinal", "text"))))["text"], ", "
    )
    text = F.concat("column_name", F.when(F.col("is_descending_key"), " DESC").otherwise(""))
    ordinal = F.when(F.col("is_included_column"), F.col("index_column_id")).otherwise(F.col("key_ordinal"))
    named = columns.withColumns({"text": text, "ordinal": ordinal}).groupBy("object_id", "index_id").agg(F.nullif(listed(False), F.lit("")).alias("key_columns"), F.nullif(listed(True), F.lit("")).alias("included_columns"))
    size = partitions.groupBy("object_id", "index_id").agg(F.sum("row_count").alias("row_count"), _mb(F.sum("used_page_count")).alias("used_mb"))
    out = indexes
    for other in (named, size, usage):
        out = out.join(other, ["object_id", "index_id"], "left")
    reads = F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")
    return out.select("object_id", "index_id", "name", "type_desc", "is_unique", "key_columns", "included_columns", "row_count", "used_mb", reads.alias("reads"), F.col("user_updates").alias("writes"), F.greatest("last_user_seek", "last_user_scan", "last_user_lookup").alias("last_read"))


def missing_indexes(details: DataFrame, stats: DataFrame, indexes: DataFrame, tables_most: int = 3, groups_most: int = 8, indexes_most: int = 15) -> DataFrame:
    """The tables with the most promising missing-index groups, those groups, and the tables' own indexes, as tagged rows.

    A group's score is cost x impact x uses. Rows are tagged 'table', 'missing' or 'existing' and ordered by the
    table's rank, kind and place; at most 3 + 24 + 45 rows with the default limits.
    """
    score = F.col("avg_total_user_cost") * F.col("avg_user_impact") * (F.col("user_seeks") + F.col("user_scans"))
    groups = details.join(stats, "group_handle").select("object_id", "group_handle", "equality_columns", "inequality_columns", "included_columns", score.alias("score"))
    ranked = groups.groupBy("object_id").agg(F.sum("score").alias("total"), F.count("*").alias("n_groups")).orderBy(F.desc("total"), "object_id").limit(tables_most)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "object_id")))  # over ``tables_most`` rows
    seq = lambda *order: F.row_number().over(Window.partitionBy("object_id").orderBy(*order))
    table = ranked.select("rank", F.lit("table").alias("row_kind"), F.lit(1).alias("seq"), "object_id", F.col("total").alias("score"), F.col("n_groups").cast("string").alias("columns"))
    texts = F.concat_ws("; ", "equality_columns", "inequality_columns", "included_columns")
    missing = groups.join(F.broadcast(ranked.select("object_id", "rank")), "object_id").withColumn("seq", seq(F.desc("score"), F.asc("group_handle"))).where(F.col("seq") <= groups_most)
    existing = indexes.join(F.broadcast(ranked.select("object_id", "rank")), "object_id").withColumn("seq", seq(F.asc("index_id"))).where(F.col("seq") <= indexes_most)
    missing = missing.select("rank", F.lit("missing").alias("row_kind"), "seq", "object_id", "score", texts.alias("columns"))
    existing = existing.select("rank", F.lit("existing").alias("row_kind"), "seq", "object_id", F.lit(None).cast("double").alias("score"), F.col("key_columns").alias("columns"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("table", 0), ("missing", 1), ("existing", 2)) for x in p]), F.col("row_kind"))
    return table.unionByName(missing).unionByName(existing).orderBy("rank", kind, "seq")


def blocked_processes_check(sessions: DataFrame, events: DataFrame, targets: DataFrame, configurations: DataFrame, most: int = 21) -> DataFrame:
    """Whether blocked processes would be reported: a verdict for each session that catches the event, else one sentinel row.

    OK needs a running session, a target and a threshold that are all known; anything known to be missing is NOT_OK
    before anything unknown makes it UNKNOWN.
    """
    threshold = configurations.where("name = 'blocked process threshold (s)'").agg(F.max("value_in_use").cast("int").alias("threshold"))
    catching = events.where("event_name = 'blocked_process_report'").select("session_id").distinct()
    with_target = targets.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("target_name")), ", ").alias("targets"))
    rows = sessions.join(catching, "session_id", "left_semi").join(with_target, "session_id", "left").join(F.broadcast(threshold))
    missing = F.concat_ws("; ", F.when(~F.col("is_running"), "session does not run"), F.when(F.col("targets").isNull(), "no target"), F.when(F.col("threshold") == 0, "threshold is 0"))
    unknown = F.concat_ws("; ", F.when(F.col("is_running").isNull(), "state unknown"), F.when(F.col("threshold").isNull(), "threshold unknown"))
    verdict = F.when(missing != "", "NOT_OK").when(unknown != "", "UNKNOWN").otherwise("OK")
    out = rows.select(F.col("name").alias("session_name"), verdict.alias("verdict"), F.nullif(F.concat_ws("; ", F.nullif(missing, F.lit("")), F.nullif(unknown, F.lit(""))), F.lit("")).alias("reason"), "targets", "threshold")
    out = or_sentinel(out, verdict="NOT_OK", reason="no session catches the event")
    order = F.when(F.col("verdict") == "OK", 0).when(F.col("verdict") == "UNKNOWN", 1).otherwise(2)
    return out.orderBy(order, "session_name").limit(most)
