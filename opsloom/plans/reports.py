"""The diagnostic reports as registered queries, each with its oracle SQL.

The reports read snapshots of a server's system views. Here the driver's tables stand for them: a snapshot is a plain
projection, in SQL that Spark and DuckDB both read, so that only the report itself is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from opsloom.plans import diagnostics
from opsloom.plans.operations import table
from opsloom.plans.registry import register

#: Snapshot -> its projection; tables stand in braces.
SNAPSHOTS = {
    "objects": "SELECT p_partkey AS object_id, CASE WHEN p_partkey % 11 = 0 THEN 'sys' ELSE 'dbo' END AS schema_name, CASE p_partkey WHEN 6 THEN 'IndexOptimize' WHEN 12 THEN 'CommandLog' WHEN 13 THEN 'DatabaseBackup' WHEN 22 THEN 'Queue' ELSE 'o_' || p_partkey END AS name, CASE p_partkey % 5 WHEN 0 THEN 'USER_TABLE' WHEN 1 THEN 'SQL_STORED_PROCEDURE' WHEN 2 THEN 'VIEW' WHEN 3 THEN 'SQL_TRIGGER' ELSE 'SQL_SCALAR_FUNCTION' END AS type_desc, p_partkey % 11 = 0 AS is_ms_shipped, TIMESTAMP '2024-01-02 03:04:05' AS modify_date FROM {part}",
    "modules": "SELECT p_partkey AS object_id, CASE WHEN p_partkey = 6 THEN 'a --// Version: 2022-12-03 17:23:44 //--' WHEN p_partkey % 7 = 0 THEN 'set NoCount on; select @x = a from inserted  ' WHEN p_partkey % 7 = 1 THEN 'declare c cursor; if 1 = (select count(*) from deleted) rollback' WHEN p_partkey % 7 = 2 THEN 'begin tran; if @@rowcount = 0 return' ELSE 'select * from O_' || (p_partkey * 3 % 200) END AS definition, p_partkey % 2 = 0 AS is_schema_bound FROM {part} WHERE p_partkey % 5 <> 0",
    "dependencies": "SELECT l_orderkey % 200 AS referencing_id, CASE WHEN l_quantity < 10 THEN CAST(NULL AS BIGINT) ELSE l_partkey % 200 END AS referenced_id, 'o_' || (l_partkey % 200) AS referenced_entity_name FROM {lineitem}",
    "parameters": "SELECT DISTINCT l_partkey AS object_id, l_linenumber - 1 AS parameter_id, '@p' || l_linenumber AS name, CASE l_linenumber % 2 WHEN 0 THEN 'int' ELSE 'nvarchar' END AS type_name, l_linenumber = 3 AS is_output FROM {lineitem}",
    "triggers": "SELECT p_partkey AS object_id, p_partkey - 3 AS parent_id, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS parent_class, 'tr_' || p_partkey AS name, p_size > 25 AS is_disabled, p_size % 2 = 0 AS is_instead_of_trigger FROM {part} WHERE p_partkey % 5 = 3",
    "synonyms": "SELECT p_partkey AS object_id FROM {part} WHERE p_partkey % 7 = 0",
    "partition_stats": "SELECT l_partkey AS object_id, l_linenumber % 3 AS index_id, CAST(l_orderkey % 4 + 1 AS INT) AS partition_number, CAST(l_quantity AS BIGINT) AS row_count, CAST(l_quantity * 3 AS BIGINT) AS reserved_page_count, CAST(l_quantity * 2 AS BIGINT) AS used_page_count, CAST(l_quantity AS BIGINT) AS in_row_data_page_count, CAST(l_linenumber AS BIGINT) AS lob_used_page_count, l_orderkey % 2 AS row_overflow_used_page_count FROM {lineitem}",
    "jobs": "SELECT s_suppkey AS job_id, s_name AS name, CAST(s_suppkey % 2 AS INT) AS enabled, 'owner_' || s_nationkey AS owner FROM {supplier}",
    "job_servers": "SELECT s_suppkey AS job_id, CAST(s_suppkey % 6 AS INT) AS last_run_outcome, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 20240101 + s_suppkey % 28 END AS INT) AS last_run_date, CAST(s_suppkey % 24 * 10000 + s_suppkey % 60 AS INT) AS last_run_time, CAST(s_suppkey * 1237 % 230000 AS INT) AS last_run_duration FROM {supplier} WHERE s_suppkey % 10 <> 9",
    "job_history": "SELECT o_custkey % 100 AS job_id, CAST(o_orderkey % 3 AS INT) AS step_id, CAST(20240101 + o_orderkey % 28 AS INT) AS run_date, CAST(o_orderkey % 24 * 10000 AS INT) AS run_time, o_orderkey AS instance_id, o_orderpriority || ' ' || o_orderkey AS message FROM {orders}",
    "job_schedules": "SELECT c_custkey % 70 AS job_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 20250101 + c_custkey % 28 END AS INT) AS next_run_date, CAST(c_custkey % 24 * 10000 + 59 AS INT) AS next_run_time FROM {customer}",
    "job_activity": "SELECT event_id % 50 AS job_id, user_id % 5 AS session_id, ts AS start_execution_date, CASE WHEN event_id % 2 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE ts END AS stop_execution_date FROM {events}",
    "agent_sessions": "SELECT user_id % 5 AS session_id FROM {events}",
    "backups": "SELECT o_orderkey AS backup_set_id, 'db_' || (o_custkey % 5) AS database_name, o_orderkey % 50 AS media_set_id, o_orderdate AS backup_start_date, o_orderdate + INTERVAL '1' HOUR AS backup_finish_date, o_orderstatus AS type, o_orderkey % 9 = 0 AS is_snapshot, o_orderkey % 4 = 0 AS is_copy_only, o_orderkey * 1000003 AS backup_size, o_orderkey * 500009 AS compressed_backup_size FROM {orders}",
    "media": "SELECT c_custkey % 60 AS media_set_id, CAST((c_custkey - c_custkey % 60) / 60 + 1 AS INT) AS family_sequence_number, CAST(c_custkey % 2 AS INT) AS mirror, CAST(c_custkey % 3 + 2 AS INT) AS device_type, c_name AS physical_device_name FROM {customer}",
    "databases": "SELECT n_name AS name, n_nationkey + 1 AS database_id, CASE n_nationkey % 6 WHEN 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc, n_regionkey % 2 * 60 AS target_recovery_time_in_seconds FROM {nation}",
    "files": "SELECT c_nationkey + 1 AS database_id, c_name AS name, CASE c_custkey % 2 WHEN 0 THEN 'ROWS' ELSE 'LOG' END AS type_desc, CAST(c_custkey * 17 AS INT) AS size, CAST(c_custkey % 3 * 5 AS INT) AS growth, c_custkey % 4 = 0 AS is_percent_growth FROM {customer}",
    "system": "SELECT 'Developer' AS edition, 8 AS cpu_count FROM {region} WHERE r_regionkey = 0",
    "nodes": "SELECT CASE r_regionkey WHEN 4 THEN 'OFFLINE' ELSE 'ONLINE' END AS node_state_desc FROM {region}",
    "schedulers": "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'VISIBLE OFFLINE' WHEN 1 THEN 'HIDDEN ONLINE' ELSE 'VISIBLE ONLINE' END AS status FROM {nation}",
    "configurations": "SELECT CASE n_nationkey WHEN 3 THEN 'max degree of parallelism' WHEN 4 THEN 'cost threshold for parallelism' WHEN 5 THEN 'blocked process threshold (s)' ELSE n_name END AS name, CAST(n_nationkey * 2 AS BIGINT) AS value_in_use FROM {nation}",
    "requests": "SELECT o_orderkey AS session_id, CASE o_orderkey % 8 WHEN 0 THEN 'BACKUP DATABASE' WHEN 1 THEN 'DBCC' WHEN 2 THEN 'KILLED/ROLLBACK' WHEN 3 THEN 'CREATE INDEX' ELSE 'SELECT' END AS command, o_orderstatus AS status, o_orderdate AS start_time, CAST(o_orderkey % 3 AS DOUBLE) / 2 AS percent_complete, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS wait_type, o_orderkey % 100 AS wait_time, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 2 ELSE 0 END AS blocking_session_id FROM {orders}",
    "sessions": "SELECT o_orderkey AS session_id, CASE o_orderkey % 2 WHEN 0 THEN 'sleeping' ELSE 'running' END AS status, 'login_' || (o_custkey % 9) AS login_name, CAST(o_orderkey % 4 AS INT) AS open_transaction_count FROM {orders}",
    "indexes": "SELECT DISTINCT l_partkey AS object_id, l_linenumber AS index_id, 'ix_' || l_linenumber AS name, CASE l_linenumber WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc, l_linenumber = 1 AS is_unique FROM {lineitem}",
    "index_columns": "SELECT l_partkey AS object_id, l_linenumber AS index_id, 'c' || l_suppkey AS column_name, l_quantity > 25 AS is_included_column, l_returnflag = 'A' AS is_descending_key, CAST(l_orderkey % 5 AS INT) AS key_ordinal, CAST(l_orderkey % 7 AS INT) AS index_column_id FROM {lineitem}",
    "usage": "SELECT l_partkey AS object_id, l_linenumber AS index_id, CAST(count(*) AS BIGINT) AS user_seeks, CAST(sum(l_orderkey % 3) AS BIGINT) AS user_scans, CAST(sum(l_orderkey % 2) AS BIGINT) AS user_lookups, CAST(sum(l_orderkey % 5) AS BIGINT) AS user_updates, max(l_shipdate) AS last_user_seek, max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS last_user_scan, CAST(NULL AS TIMESTAMP) AS last_user_lookup FROM {lineitem} WHERE l_linenumber <> 2 GROUP BY l_partkey, l_linenumber",
    "missing_details": "SELECT p_partkey AS group_handle, p_partkey % 13 AS object_id, '[a' || p_size || ']' AS equality_columns, CASE p_partkey % 2 WHEN 0 THEN '[b]' END AS inequality_columns, CASE p_partkey % 3 WHEN 0 THEN '[c], [d]' END AS included_columns FROM {part}",
    "missing_stats": "SELECT p_partkey AS group_handle, CAST(p_size AS DOUBLE) AS avg_total_user_cost, CAST(p_partkey % 100 AS DOUBLE) AS avg_user_impact, p_partkey % 17 AS user_seeks, p_partkey % 3 AS user_scans FROM {part}",
    "own_indexes": "SELECT p_partkey % 13 AS object_id, p_partkey AS index_id, 'k' || p_partkey AS key_columns FROM {part}",
    "event_sessions": "SELECT n_nationkey AS session_id, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_running FROM {nation}",
    "session_events": "SELECT n_nationkey AS session_id, CASE n_nationkey % 5 WHEN 4 THEN 'other' ELSE 'blocked_process_report' END AS event_name FROM {nation}",
    "session_targets": "SELECT c_nationkey AS session_id, c_mktsegment AS target_name FROM {customer} WHERE c_nationkey < 20",
}

MB = "CAST(round({} * 8 / 1024, 2) AS DECIMAL(18,2))"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
STAMP = "CASE WHEN {0} > 0 THEN substr(CAST({0} AS VARCHAR), 1, 4) || '-' || substr(CAST({0} AS VARCHAR), 5, 2) || '-' || substr(CAST({0} AS VARCHAR), 7, 2) || 'T' || substr(lpad(CAST({1} AS VARCHAR), 6, '0'), 1, 2) || ':' || substr(lpad(CAST({1} AS VARCHAR), 6, '0'), 3, 2) || ':' || substr(lpad(CAST({1} AS VARCHAR), 6, '0'), 5, 2) END"


def snapshots(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The snapshots of these names over the tables in ``sf_dir``."""
    tables = lambda text: {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return [spark.sql(SNAPSHOTS[n], **tables(SNAPSHOTS[n])) for n in names]


def oracle(sql: str) -> str:
    """``sql`` with the snapshots that it names (``s_`` before each) as common table expressions."""
    names = list(dict.fromkeys(n for n in re.findall(r"\bs_(\w+)", sql) if n in SNAPSHOTS))
    return "WITH " + ", ".join(f"s_{n} AS ({re.sub(r'[{}]', '', SNAPSHOTS[n])})" for n in names) + f" {sql}"


@register(
    "report_tables_largest",
    oracle(f"""SELECT schema_name, name AS table_name, CAST(sum(row_count) FILTER (WHERE index_id < 2) AS BIGINT) AS row_count, {MB.format('sum(reserved_page_count)')} AS reserved_mb, {MB.format('sum(used_page_count)')} AS used_mb,
    {MB.format('coalesce(sum(in_row_data_page_count) FILTER (WHERE index_id < 2), 0)')} AS in_row_mb, {MB.format('sum(lob_used_page_count)')} AS lob_mb, {MB.format('sum(row_overflow_used_page_count)')} AS row_overflow_mb,
    count(DISTINCT index_id) AS index_count, max(partition_number) AS partition_count
    FROM s_partition_stats JOIN s_objects USING (object_id) WHERE NOT is_ms_shipped AND type_desc = 'USER_TABLE' GROUP BY schema_name, name ORDER BY sum(reserved_page_count) DESC, schema_name, table_name LIMIT 50"""),
)
def report_tables_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, objects = snapshots(spark, sf_dir, "partition_stats", "objects")
    return diagnostics.tables_largest(stats, objects.where("type_desc = 'USER_TABLE'"))


@register(
    "report_agent_jobs",
    oracle(f"""SELECT name AS job_name, enabled = 1 AS is_enabled, owner, CASE last_run_outcome WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'retry' WHEN 3 THEN 'canceled' WHEN 4 THEN 'in progress' ELSE 'unknown' END AS last_outcome,
    coalesce(last_run_date, 0) = 0 AS never_run, {STAMP.format('last_run_date', 'last_run_time')} AS last_run, CAST(last_run_duration // 10000 * 3600 + last_run_duration // 100 % 100 * 60 + last_run_duration % 100 AS BIGINT) AS last_duration_s,
    substr(h.message, 1, 400) AS last_message, job_id IN (SELECT job_id FROM s_job_activity WHERE stop_execution_date IS NULL AND session_id = (SELECT max(session_id) FROM s_agent_sessions)) AS is_running,
    {STAMP.format('n.next_run_date', 'n.next_run_time')} AS next_run, coalesce(schedule_count, 0) AS schedule_count
    FROM s_jobs LEFT JOIN s_job_servers USING (job_id)
    LEFT JOIN (SELECT job_id, message FROM s_job_history WHERE step_id = 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY run_date DESC, run_time DESC, instance_id DESC) = 1) h USING (job_id)
    LEFT JOIN (SELECT * FROM s_job_schedules WHERE next_run_date > 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY next_run_date, next_run_time) = 1) n USING (job_id)
    LEFT JOIN (SELECT job_id, count(*) AS schedule_count FROM s_job_schedules GROUP BY job_id) USING (job_id)
    ORDER BY CASE WHEN last_run_outcome = 0 THEN 0 ELSE 1 END, name, job_id LIMIT 300"""),
)
def report_agent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.agent_jobs(*snapshots(spark, sf_dir, "jobs", "job_servers", "job_history", "job_schedules", "job_activity", "agent_sessions"))


@register(
    "report_backup_history",
    oracle(f"""SELECT database_name, {ISO.format('backup_start_date')} AS backup_start, {ISO.format('backup_finish_date')} AS backup_finish, CAST(epoch(backup_finish_date) - epoch(backup_start_date) AS BIGINT) AS duration_s, type AS backup_type, is_snapshot, is_copy_only,
    CAST(round(backup_size / 1048576, 1) AS DECIMAL(18,1)) AS size_mb, CAST(round(compressed_backup_size / 1048576, 1) AS DECIMAL(18,1)) AS compressed_mb, device_type, physical_device_name, coalesce(stripe_count, 0) AS stripe_count
    FROM s_backups LEFT JOIN (SELECT media_set_id, device_type, physical_device_name FROM s_media WHERE family_sequence_number = 1 AND mirror = 0) USING (media_set_id)
    LEFT JOIN (SELECT media_set_id, count(*) AS stripe_count FROM s_media WHERE mirror = 0 GROUP BY media_set_id) USING (media_set_id)
    WHERE database_name = 'db_2' AND backup_start_date >= TIMESTAMP '1999-01-01' - INTERVAL 300 DAY ORDER BY backup_start_date DESC, backup_set_id LIMIT 500"""),
)
def report_backup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.backup_history(*snapshots(spark, sf_dir, "backups", "media"), "db_2", 300, "1999-01-01")


@register(
    "report_databases_nonconforming",
    oracle("""SELECT * FROM (SELECT d.name AS database_name, database_id <= 4 AS is_system, state_desc, target_recovery_time_in_seconds, 'target_recovery_time_0' AS finding, NULL AS file_name, NULL AS file_type, NULL AS size_mb, NULL AS growth_pct FROM s_databases d WHERE target_recovery_time_in_seconds = 0
    UNION ALL SELECT d.name, database_id <= 4, state_desc, target_recovery_time_in_seconds, 'percent_growth', f.name, type_desc, CAST(round(size * 8 / 1024, 1) AS DECIMAL(18,1)), growth FROM s_databases d JOIN s_files f USING (database_id) WHERE is_percent_growth AND growth > 0)
    ORDER BY database_name, finding, file_name LIMIT 500"""),
)
def report_databases_nonconforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.databases_nonconforming(*snapshots(spark, sf_dir, "databases", "files"))


@register(
    "report_object_references",
    oracle("""SELECT DISTINCT source, schema_name AS referencing_schema, name AS referencing_name, type_desc AS referencing_type FROM
    (SELECT referencing_id AS object_id, 'declared' AS source FROM s_dependencies WHERE referenced_id = 15 OR (referenced_id IS NULL AND referenced_entity_name = 'o_15') UNION SELECT object_id, 'text_match' FROM s_modules WHERE contains(lower(definition), 'o_15'))
    JOIN s_objects USING (object_id) WHERE source = 'declared' OR NOT is_ms_shipped"""),
)
def report_object_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.object_references(*snapshots(spark, sf_dir, "objects", "modules", "dependencies"), 15, "o_15")


@register(
    "report_proc_source",
    oracle("""SELECT schema_name, name AS object_name, type_desc, (SELECT string_agg(name || ' ' || type_name || CASE WHEN is_output THEN ' OUTPUT' ELSE '' END, ', ' ORDER BY parameter_id) FROM s_parameters WHERE object_id = 16 AND parameter_id > 0) AS parameters, definition
    FROM s_objects JOIN s_modules USING (object_id) WHERE object_id = 16"""),
)
def report_proc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.proc_source(*snapshots(spark, sf_dir, "objects", "modules", "parameters"), 16)


@register(
    "report_triggers",
    oracle("""SELECT p.schema_name AS parent_schema, p.name AS parent_object, o.schema_name AS trigger_schema, t.name AS trigger_name, is_disabled, is_instead_of_trigger, o.modify_date, CAST(definition ILIKE '%NOCOUNT%' AS INT) AS sets_nocount, CAST(definition ILIKE '%@@ROWCOUNT%' AS INT) AS reads_rowcount,
    CAST(definition ILIKE '%=%(SELECT%inserted%' OR definition ILIKE '%=%(SELECT%deleted%' OR definition ILIKE '%SELECT%@%=%FROM%inserted%' OR definition ILIKE '%SELECT%@%=%FROM%deleted%' AS INT) AS scalar_from_inserted, CAST(definition ILIKE '%CURSOR%' AS INT) AS has_cursor,
    CAST(definition ILIKE '%ROLLBACK%' AS INT) AS has_rollback, CAST(definition ILIKE '%BEGIN TRAN%' AS INT) AS has_transaction, CAST(length(rtrim(definition)) AS INT) AS definition_length
    FROM s_triggers t JOIN s_objects o USING (object_id) JOIN s_modules USING (object_id) LEFT JOIN s_objects p ON p.object_id = parent_id WHERE parent_class = 1 AND NOT o.is_ms_shipped"""),
)
def report_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.triggers_inventory(*snapshots(spark, sf_dir, "triggers", "objects", "modules"))


@register(
    "report_view_diagnose",
    oracle("""SELECT schema_name, name AS view_name, is_schema_bound, (SELECT count(*) FROM s_dependencies JOIN s_synonyms s ON s.object_id = referenced_id WHERE referencing_id = 17) AS synonyms_referenced,
    (SELECT count(*) FROM s_dependencies WHERE referencing_id = 17 AND referenced_id IS NULL) AS unresolved_references, definition FROM s_objects JOIN s_modules USING (object_id) WHERE object_id = 17 AND type_desc = 'VIEW'"""),
)
def report_view_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, *others = snapshots(spark, sf_dir, "objects", "modules", "dependencies", "synonyms")
    return diagnostics.view_diagnose(objects.where("type_desc = 'VIEW'"), *others, 17)


@register(
    "report_cpu_topology",
    oracle("""SELECT edition, cpu_count, (SELECT count(*) FROM s_nodes WHERE node_state_desc = 'ONLINE') AS numa_nodes, (SELECT count(*) FROM s_schedulers WHERE status = 'VISIBLE ONLINE') AS schedulers_online, (SELECT count(*) FROM s_schedulers WHERE status = 'VISIBLE OFFLINE') AS schedulers_offline,
    (SELECT CAST(max(value_in_use) AS INT) FROM s_configurations WHERE name = 'max degree of parallelism') AS maxdop, (SELECT CAST(max(value_in_use) AS INT) FROM s_configurations WHERE name = 'cost threshold for parallelism') AS cost_threshold, (SELECT max(value_in_use) FROM s_configurations WHERE name = 'affinity mask') AS affinity_mask FROM s_system"""),
)
def report_cpu_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.cpu_topology(*snapshots(spark, sf_dir, "system", "nodes", "schedulers", "configurations"))


@register(
    "report_maintenance",
    oracle(f"""SELECT r.session_id, r.command, r.status, {ISO.format('r.start_time')} AS started, CAST(epoch(TIMESTAMP '2003-01-01') - epoch(r.start_time) AS BIGINT) AS elapsed_s, CAST(r.percent_complete AS DECIMAL(5,1)) AS percent_complete, r.wait_type, r.wait_time AS wait_ms, nullif(r.blocking_session_id, 0) AS blocking_session_id,
    b.command AS blocker_command, bs.status AS blocker_status, b.wait_type AS blocker_wait_type, bs.open_transaction_count AS blocker_open_transactions, (SELECT count(*) FROM s_requests x WHERE x.blocking_session_id = r.session_id AND x.blocking_session_id <> 0) AS blocks_count, s.login_name
    FROM s_requests r JOIN s_sessions s USING (session_id) LEFT JOIN s_sessions bs ON bs.session_id = nullif(r.blocking_session_id, 0) LEFT JOIN s_requests b ON b.session_id = nullif(r.blocking_session_id, 0)
    WHERE r.session_id <> 5 AND (r.command LIKE 'BACKUP%' OR r.command LIKE 'RESTORE%' OR r.command LIKE 'ALTER%' OR r.command LIKE 'DBCC%' OR r.command LIKE 'CREATE INDEX%' OR r.command = 'KILLED/ROLLBACK' OR r.percent_complete > 0) ORDER BY r.start_time, r.session_id LIMIT 100"""),
)
def report_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.maintenance_in_progress(*snapshots(spark, sf_dir, "requests", "sessions"), "2003-01-01", 5)


@register(
    "report_solution_versions",
    oracle("""SELECT schema_name, name AS object_name, type_desc, CASE WHEN contains(definition, '--// Version: ') THEN substr(definition, instr(definition, '--// Version: ') + 14, 19) END AS version FROM s_objects LEFT JOIN s_modules USING (object_id)
    WHERE name IN ('CommandExecute', 'DatabaseBackup', 'DatabaseIntegrityCheck', 'IndexOptimize', 'CommandLog', 'Queue', 'QueueDatabase') AND NOT is_ms_shipped"""),
)
def report_solution_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.solution_versions(*snapshots(spark, sf_dir, "objects", "modules"))


@register(
    "report_index_usage",
    oracle(f"""SELECT i.object_id, i.index_id, name, type_desc, is_unique, key_columns, included_columns, row_count, used_mb, user_seeks + user_scans + user_lookups AS reads, user_updates AS writes, greatest(last_user_seek, last_user_scan, last_user_lookup) AS last_read FROM s_indexes i
    LEFT JOIN (SELECT object_id, index_id, string_agg(t, ', ' ORDER BY key_ordinal, t) FILTER (WHERE NOT is_included_column) AS key_columns, string_agg(t, ', ' ORDER BY index_column_id, t) FILTER (WHERE is_included_column) AS included_columns
    FROM (SELECT *, column_name || CASE WHEN is_descending_key THEN ' DESC' ELSE '' END AS t FROM s_index_columns) GROUP BY object_id, index_id) c USING (object_id, index_id)
    LEFT JOIN (SELECT object_id, index_id, CAST(sum(row_count) AS BIGINT) AS row_count, {MB.format('sum(used_page_count)')} AS used_mb FROM s_partition_stats GROUP BY object_id, index_id) p USING (object_id, index_id) LEFT JOIN s_usage u USING (object_id, index_id)"""),
)
def report_index_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.index_usage(*snapshots(spark, sf_dir, "indexes", "index_columns", "usage", "partition_stats"))


@register(
    "report_missing_indexes",
    oracle("""SELECT * REPLACE (CAST(rank AS INT) AS rank, CAST(seq AS INT) AS seq) FROM (WITH g AS (SELECT *, avg_total_user_cost * avg_user_impact * (user_seeks + user_scans) AS score FROM s_missing_details JOIN s_missing_stats USING (group_handle)),
    t AS (SELECT *, row_number() OVER (ORDER BY total DESC, object_id) AS rank FROM (SELECT object_id, sum(score) AS total, count(*) AS n FROM g GROUP BY object_id) QUALIFY rank <= 3)
    SELECT rank, 'table' AS row_kind, 1 AS seq, object_id, total AS score, CAST(n AS VARCHAR) AS columns FROM t
    UNION ALL SELECT * FROM (SELECT rank, 'missing', row_number() OVER (PARTITION BY object_id ORDER BY score DESC, group_handle) AS seq, object_id, score, concat_ws('; ', equality_columns, inequality_columns, included_columns) FROM g JOIN t USING (object_id)) WHERE seq <= 8
    UNION ALL SELECT * FROM (SELECT rank, 'existing', row_number() OVER (PARTITION BY object_id ORDER BY index_id) AS seq, object_id, NULL, key_columns FROM s_own_indexes JOIN t USING (object_id)) WHERE seq <= 15)"""),
)
def report_missing_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.missing_indexes(*snapshots(spark, sf_dir, "missing_details", "missing_stats", "own_indexes"))


@register(
    "report_blocked_processes",
    oracle("""SELECT name AS session_name, CASE WHEN NOT is_running OR targets IS NULL OR threshold = 0 THEN 'NOT_OK' WHEN is_running IS NULL OR threshold IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS verdict,
    nullif(concat_ws('; ', CASE WHEN NOT is_running THEN 'session does not run' END, CASE WHEN targets IS NULL THEN 'no target' END, CASE WHEN threshold = 0 THEN 'threshold is 0' END, CASE WHEN is_running IS NULL THEN 'state unknown' END, CASE WHEN threshold IS NULL THEN 'threshold unknown' END), '') AS reason, targets, threshold
    FROM (SELECT *, (SELECT CAST(max(value_in_use) AS INT) FROM s_configurations WHERE name = 'blocked process threshold (s)') AS threshold FROM s_event_sessions WHERE session_id IN (SELECT session_id FROM s_session_events WHERE event_name = 'blocked_process_report'))
    LEFT JOIN (SELECT session_id, string_agg(DISTINCT target_name, ', ' ORDER BY target_name) AS targets FROM s_session_targets GROUP BY session_id) USING (session_id)
    ORDER BY CASE verdict WHEN 'OK' THEN 0 WHEN 'UNKNOWN' THEN 1 ELSE 2 END, session_name LIMIT 21"""),
)
def report_blocked_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.blocked_processes_check(*snapshots(spark, sf_dir, "event_sessions", "session_events", "session_targets", "configurations"))
