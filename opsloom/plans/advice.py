"""Registered queries of the index advisor, the log's beginning and values, each with its oracle SQL.

The tables stand for operations data as in ``operations``: orders for reads, writes and candidates, nation for existing
indexes, events for the lines of a log (a file for each type of event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import scalar as S
from opsloom.operators import advisor, bounded, digest
from opsloom.plans.operations import CLASSIFIED_SQL, LOG_SQL, classified, log, table
from opsloom.plans.registry import register


# -- the log


@register("unaggregated_entries", f"SELECT CAST(1 AS BIGINT) AS n, text, seq AS first_seq FROM ({CLASSIFIED_SQL}) WHERE dropped IS NULL")
def unaggregated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.unaggregated(classified(spark, sf_dir).where("dropped is null")).select("n", "text", "first_seq")


@register("excluded_by_marker", f"SELECT seq, text FROM ({LOG_SQL}) WHERE NOT contains(text, 'user 1')")
def excluded_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(~F.col("text").contains("user 1")).select("seq", "text")


@register(
    "log_counters_in_window",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM (SELECT dropped IS NULL AND (time IS NULL OR (time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20')) AS ok FROM ({CLASSIFIED_SQL}))",
)
def log_counters_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.counters(classified(spark, sf_dir), inside=digest.in_window(F.col("time"), "2024-01-10", "2024-01-20"))


def _boots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.boot_text(log(spark, sf_dir).withColumn("file", F.substring_index("text", " ", 1)))


BOOT_SQL = f"SELECT file, string_agg(text, chr(10) ORDER BY seq) AS boot FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS nth FROM (SELECT *, split_part(text, ' ', 1) AS file FROM ({LOG_SQL}))) WHERE nth <= 400 GROUP BY file"


@register(
    "log_boot_facts",
    f"""WITH b AS ({BOOT_SQL}), x AS (SELECT file, regexp_extract_all(boot, 'from 10.0.([0-9])[0-9]*[.]', 1) AS l FROM b), m AS (SELECT file, l[i] AS v, i FROM x, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
    u AS (SELECT file, string_agg(v, ',' ORDER BY met) AS nets FROM (SELECT file, v, min(i) AS met FROM m GROUP BY file, v) GROUP BY file)
    SELECT file, nullif(regexp_extract(boot, 'user ([0-9]+)', 1), '') AS first_user, nullif(regexp_extract(boot, 'no such fact (.)', 1), '') AS absent, nets FROM b LEFT JOIN u USING (file)""",
)
def log_boot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.facts(_boots(spark, sf_dir), {"first_user": "user ([0-9]+)", "absent": "no such fact (.)"}, {"nets": "from 10.0.([0-9])[0-9]*[.]"})
    return found.withColumn("nets", F.array_join("nets", ","))


CHECKS = [("user 1[0-9]* ", "a user of the first kind"), ("^purchase", "purchases at the start"), ("no such line", "never")]


@register("log_boot_checks", " UNION ALL ".join(f"SELECT file, {i} AS nth, '{m}' AS message FROM ({BOOT_SQL}) WHERE regexp_matches(boot, '{p}')" for i, (p, m) in enumerate(CHECKS)))
def log_boot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.checks(_boots(spark, sf_dir), CHECKS)


ENTITY_LOG = "SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'Login failed for user ''DOM\\Eric' || user_id % 7 || '''.' WHEN 1 THEN 'Database: db_' || user_id % 5 || ' is up' WHEN 2 THEN 'client 10.1.' || user_id % 9 || '.4 closed' ELSE 'no entity ' || event_id END AS text, CASE event_id % 4 WHEN 0 THEN 'DOM\\Eric' || user_id % 7 WHEN 1 THEN 'db_' || user_id % 5 WHEN 2 THEN '10.1.' || user_id % 9 || '.4' END AS v, ['LOGIN', 'DB', 'IP'][event_id % 4 + 1] AS kind FROM events"


@register(
    "log_entities_redacted",
    f"""WITH l AS ({ENTITY_LOG}), f AS (SELECT kind, v, min(seq) AS met FROM l WHERE v IS NOT NULL GROUP BY kind, v),
    t AS (SELECT kind, v, '<' || kind || '_' || row_number() OVER (PARTITION BY kind ORDER BY met) || '>' AS token FROM f)
    SELECT seq, CASE WHEN token IS NULL THEN text ELSE replace(text, l.v, token) END AS text FROM l LEFT JOIN t ON l.kind = t.kind AND l.v = t.v""",
)
def log_entities_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = lambda n: (F.col("user_id") % n).cast("string")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("Login failed for user 'DOM\\Eric"), user(7), F.lit("'.")))
        .when(kind == 1, F.concat(F.lit("Database: db_"), user(5), F.lit(" is up")))
        .when(kind == 2, F.concat(F.lit("client 10.1."), user(9), F.lit(".4 closed")))
        .otherwise(F.concat(F.lit("no entity "), F.col("event_id").cast("string")))
    )
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("f").alias("file"), text.alias("text"))
    return digest.redact(lines, seq=("file", "seq")).select("seq", "text")


# -- values


@register(
    "stuffed_names",
    "SELECT p_partkey, CASE WHEN length(p_name) >= 3 THEN left(p_name, 2) || '--' || substr(p_name, 6) END AS name FROM part",
)
def stuffed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.stuff(F.col("p_name"), 3, 3, "--").alias("name"))


@register(
    "parsed_dates",
    """SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS time FROM events WHERE ts IS NOT NULL""",
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    text = F.when(k == 0, form("yyyy-MM-dd")).when(k == 1, form("yyyy-MM-dd'T'HH:mm")).when(k == 2, F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit(".123"))).otherwise(form("dd/MM/yyyy"))
    e = table(spark, sf_dir, "events").where("ts is not null")
    return e.select("event_id", F.date_format(S.parsed_time(text), "yyyy-MM-dd HH:mm:ss").alias("time"))


@register(
    "typed_parameters",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 300 <= 255 THEN CAST(o_orderkey % 300 AS VARCHAR) END AS tiny, CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS bit,
    CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority END AS short FROM orders""",
)
def typed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    bit = F.when(key % 3 == 0, "True").when(key % 3 == 1, "0").otherwise("yes")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.typed_text((key % 300).cast("string"), "tinyint").alias("tiny"), S.typed_text(bit, "bit").alias("bit"), S.typed_text(F.col("o_orderpriority"), "varchar", 6).alias("short")
    )


@register(
    "safe_file_names",
    """SELECT p_partkey, CASE WHEN raw = plain THEN plain ELSE plain || '~' || left(sha256(raw), 8) END AS name FROM (SELECT p_partkey, raw, regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g') AS plain FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'part' || p_partkey ELSE 'a/b ' || p_name END AS raw FROM part))""",
)
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("part"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("a/b "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.safe_name(raw).alias("name"))


@register(
    "effective_parallelism",
    "SELECT p_partkey, least(coalesce(nullif(p_size % 9, 0), nullif(p_partkey % 3, 0), 8), 8) AS dop FROM part",
)
def effective_parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    dop = S.effective((F.col("p_size") % 9).cast("long"), (F.col("p_partkey") % 3).cast("long"), F.lit(8).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", dop.alias("dop"))


@register(
    "resolution_class",
    "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unresolved' WHEN p_size > 25 THEN 'system' ELSE 'user' END AS class FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10",
)
def resolution_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", S.resolution(F.col("p_partkey"), F.col("p_size") > 25).alias("class"))


# -- results with an order or a cap


@register("lateral_table_function", "SELECT p_partkey, nth, word FROM (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS nth, unnest(string_split(p_name, ' ')) AS word FROM part)")
def lateral_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("nth", "word")).withColumn("nth", F.col("nth").cast("long"))


@register("ordinal_rows", "SELECT r_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ordinal, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, -1, r_name FROM region")
def ordinal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    own = bounded.top_per_group(table(spark, sf_dir, "nation"), ["n_regionkey"], [F.asc("n_nationkey")], 1 << 30, "ordinal")
    return own.select(F.col("n_regionkey").alias("k"), F.col("ordinal").cast("long"), F.col("n_name").alias("name")).join(r.select(F.col("r_regionkey").alias("k")), "k", "left_semi").unionByName(r.select(F.col("r_regionkey").alias("k"), F.lit(-1).cast("long").alias("ordinal"), F.col("r_name").alias("name")))


@register(
    "conditional_order",
    "SELECT * FROM (SELECT 'all' AS scope, s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'one', s_suppkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 10)",
)
def conditional_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = {"all": [F.desc("s_acctbal"), F.asc("s_suppkey")], "one": [F.asc("s_name"), F.asc("s_suppkey")]}
    parts = [table(spark, sf_dir, "supplier").orderBy(*o).limit(10).select(F.lit(scope).alias("scope"), "s_suppkey") for scope, o in order.items()]
    return parts[0].unionByName(parts[1])


@register(
    "writes_and_top_reads",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)",
)
def writes_and_top_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return bounded.writes_and_top_reads(o, F.col("o_orderstatus") == "O", [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey")


@register(
    "capped_messages",
    "SELECT user_id, count(*) AS n, array_to_string(list_slice(list(event_type ORDER BY event_id), 1, 20), ',') AS kept, count(*) > 20 AS truncated FROM events GROUP BY user_id",
)
def capped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded.capped_lists(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", 20).withColumn("kept", F.array_join("kept", ","))


@register(
    "merged_by_id",
    "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS queries FROM orders GROUP BY o_custkey",
)
def merged_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return by.agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("queries"))


# -- the advisor

INDEX_SQL = """SELECT n_nationkey AS index_id, n_nationkey % 3 AS table_id, n_nationkey % 4 = 1 AS is_constraint, n_nationkey % 5 <> 2 AS replaceable,
    list_concat(['c' || (n_nationkey % 2), 'd' || (n_nationkey // 2 % 2)], CASE WHEN n_nationkey % 3 = 0 THEN ['e desc'] WHEN n_nationkey % 7 = 0 THEN ['e'] ELSE [] END)[:CASE WHEN n_nationkey % 8 = 7 THEN 1 ELSE 3 END] AS keys,
    CASE WHEN n_nationkey % 2 = 0 THEN ['i0', 'i1'] ELSE ['i0'] END AS includes FROM nation"""
CAND_SQL = """SELECT o_orderkey AS candidate_id, o_orderkey % 3 AS table_id, o_custkey % 3 AS eq,
    list_concat(['d' || (o_custkey % 2), 'c' || (o_orderkey // 3 % 2)], CASE WHEN o_orderkey % 5 = 0 THEN ['e'] WHEN o_orderkey % 5 = 1 THEN ['e desc'] ELSE [] END) AS keys,
    ['i' || (o_custkey % 3)] AS includes FROM orders"""
_BARE = "list_transform({}, lambda x: replace(x, ' desc', ''))"
_TURN = "list_transform({}, lambda x: CASE WHEN x LIKE '% desc' THEN replace(x, ' desc', '') ELSE x || ' desc' END)"


def _lead_sql(keys: str, eq: str, ikeys: str) -> str:
    rest, irest = f"list_slice({keys}, {eq} + 1, len({keys}))", f"list_slice({ikeys}, {eq} + 1, len({keys}))"
    head = lambda k: f"list_sort({_BARE.format(f'list_slice({k}, 1, {eq})')})"
    return f"(len({ikeys}) >= len({keys}) AND {head(ikeys)} = {head(keys)} AND ({irest} = {rest} OR {irest} = {_TURN.format(rest)}))"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    third = F.when(F.expr("o_orderkey % 5 = 0"), F.array(F.lit("e"))).when(F.expr("o_orderkey % 5 = 1"), F.array(F.lit("e desc"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(text("d", "o_custkey % 2"), text("c", "o_orderkey div 3 % 2")), third)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.expr("o_orderkey % 3").alias("table_id"), F.expr("cast(o_custkey % 3 as int)").alias("eq_count"), keys.alias("keys"), F.array(text("i", "o_custkey % 3")).alias("includes"))


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    third = F.when(F.expr("n_nationkey % 3 = 0"), F.array(F.lit("e desc"))).when(F.expr("n_nationkey % 7 = 0"), F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    keys = F.slice(F.concat(F.array(text("c", "n_nationkey % 2"), text("d", "n_nationkey div 2 % 2")), third), F.lit(1), F.when(F.expr("n_nationkey % 8 = 7"), 1).otherwise(3))
    includes = F.when(F.expr("n_nationkey % 2 = 0"), F.array(F.lit("i0"), F.lit("i1"))).otherwise(F.array(F.lit("i0")))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("index_id"), F.expr("n_nationkey % 3").alias("table_id"), F.expr("n_nationkey % 4 = 1").alias("is_constraint"), F.expr("n_nationkey % 5 <> 2").alias("replaceable"), keys.alias("keys"), includes.alias("includes")
    )


@register(
    "coverage_confront",
    f"""WITH i AS ({INDEX_SQL}), c AS ({CAND_SQL}), p AS (SELECT candidate_id, index_id, is_constraint,
      {_lead_sql('c.keys', 'c.eq', 'i.keys')} AS same,
      len(list_filter({_BARE.format('list_concat(c.keys, c.includes)')}, lambda x: NOT list_contains({_BARE.format('list_concat(i.keys, i.includes)')}, x))) = 0 AS leaf,
      len(i.keys) < len(c.keys) AND {_lead_sql('list_slice(c.keys, 1, len(i.keys))', 'least(c.eq, len(i.keys))', 'i.keys')} AND NOT is_constraint AND replaceable AS repl
      FROM c LEFT JOIN i USING (table_id)),
    r AS (SELECT *, CASE WHEN same AND leaf THEN 0 WHEN same THEN 1 WHEN repl THEN 2 ELSE 3 END AS rank FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank, index_id) AS nth FROM r)
    SELECT candidate_id, CASE WHEN rank = 0 THEN 'covered' WHEN rank = 1 AND is_constraint THEN 'discuss' WHEN rank = 1 THEN 'widen' WHEN rank = 2 THEN 'replace' ELSE 'new' END AS decision, CASE WHEN rank < 3 THEN index_id END AS index_id FROM o WHERE nth = 1""",
)
def coverage_confront(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisor.confront(_candidates(spark, sf_dir), _indexes(spark, sf_dir))


@register(
    "effective_keys",
    f"SELECT index_id, array_to_string(CASE WHEN index_id % 2 = 0 OR index_id % 6 = 1 THEN keys ELSE list_concat(keys, list_filter(['k', 'c1'], lambda x: NOT list_contains(keys, x))) END, ',') AS effective FROM ({INDEX_SQL})",
)
def effective_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexes(spark, sf_dir).withColumns({"is_unique": F.expr("index_id % 2 = 0"), "kind": F.expr("if(index_id % 6 = 1, 'clustered', 'nonclustered')"), "clustered_keys": F.array(F.lit("k"), F.lit("c1"))})
    return advisor.effective_keys(rows).select("index_id", F.array_join("effective", ",").alias("effective"))


@register("protected_drops", "SELECT n_nationkey AS index_id, NOT (n_nationkey % 7 = 0) AND NOT (n_nationkey % 5 = 0) AND n_nationkey % 3 <> 0 AND NOT (n_nationkey % 11 = 1) AND NOT (n_nationkey % 13 = 4) AS droppable FROM nation")
def protected_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("index_id"), F.expr("n_nationkey % 7 = 0").alias("is_primary"), F.expr("n_nationkey % 5 = 0").alias("is_unique"), F.expr("if(n_nationkey % 3 = 0, 'clustered', 'nonclustered')").alias("kind"),
        F.expr("if(n_nationkey % 11 = 1, true, null)").alias("is_hinted"), F.expr("n_nationkey % 13 = 4").alias("is_forced"),
    )
    return n.select("index_id", advisor.droppable(n).alias("droppable"))


@register(
    "maintenance_cost",
    """WITH w AS (SELECT o_orderkey AS query_id, 'op' || (o_orderkey % 2) AS op, o_custkey AS candidate_id, o_orderkey % 4 = 0 AS only_this, CAST(o_totalprice AS DOUBLE) AS cost FROM orders),
    b AS (SELECT l_orderkey AS query_id, 'op' || (l_linenumber % 2) AS op, max(CAST(l_extendedprice AS DOUBLE)) AS base FROM lineitem GROUP BY 1, 2)
    SELECT query_id, candidate_id, CASE WHEN only_this THEN cost WHEN base IS NULL THEN NULL ELSE greatest(cost - base, 0.0) END AS maintenance FROM w LEFT JOIN b USING (query_id, op)""",
)
def maintenance_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    op = lambda c: F.concat(F.lit("op"), (F.col(c) % 2).cast("string")).alias("op")
    writes = o.select(F.col("o_orderkey").alias("query_id"), op("o_orderkey"), F.array(F.lit("b"), F.lit("a")).alias("others"), F.col("o_custkey").alias("candidate_id"), F.expr("o_orderkey % 4 = 0").alias("only_this"), F.col("o_totalprice").cast("double").alias("cost"))
    base = li.select(F.col("l_orderkey").alias("query_id"), op("l_linenumber"), F.array(F.lit("a"), F.lit("b")).alias("others"), F.col("l_extendedprice").cast("double").alias("cost"))
    return advisor.maintenance(writes, base).select("query_id", "candidate_id", "maintenance")


@register(
    "score_decision",
    """SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'O' AND len(notes) > 0 THEN 'discuss' WHEN o_orderstatus = 'O' THEN 'recommended' ELSE 'rejected: low gain' END AS decision, array_to_string(notes, '; ') AS notes FROM (
      SELECT *, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'a write is not measured' END, CASE WHEN o_orderkey % 5 = 0 THEN 'the index is a constraint' END, CASE WHEN o_custkey % 9 = 0 THEN 'executions are of the plan cache' END, CASE WHEN o_custkey % 6 = 0 THEN 'measures are unreliable' END, CASE WHEN o_custkey % 8 = 0 THEN 'other candidates do as well' END], lambda x: x IS NOT NULL) AS notes FROM orders)""",
)
def score_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "recommended").otherwise("rejected: low gain").alias("decision"), F.expr("if(o_orderkey % 7 = 0, 2, 0)").alias("unmeasured_writes"),
        F.expr("o_orderkey % 5 = 0").alias("is_constraint"), F.expr("o_custkey % 9 = 0").alias("from_plan_cache"), F.expr("o_custkey % 6 = 0").alias("unreliable"), F.expr("o_custkey % 8 = 0").alias("redundant"),
    )
    return advisor.with_caps(scored).select("candidate_id", "decision", F.array_join("notes", "; ").alias("notes"))


@register(
    "redundant_by_absence",
    """WITH u AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS offered, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 49), []) AS taken FROM lineitem GROUP BY l_orderkey),
    e AS (SELECT unnest(offered) AS candidate_id, taken FROM u), f AS (SELECT candidate_id, bool_or(list_contains(taken, candidate_id)) AS own, list_sort(list_distinct(flatten(list(taken)))) AS instead FROM e GROUP BY candidate_id)
    SELECT p_partkey AS candidate_id, array_to_string(instead, ',') AS instead FROM part JOIN f ON p_partkey = candidate_id WHERE NOT own""",
)
def redundant_by_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("combination_id")).agg(F.collect_set("l_partkey").alias("offered"), F.collect_set(F.when(F.col("l_quantity") > 49, F.col("l_partkey"))).alias("used"))
    return advisor.redundant_by_absence(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id")), used).withColumn("instead", F.array_join("instead", ","))


@register(
    "renamed_database",
    """WITH o AS (SELECT DISTINCT 'db' || (n_nationkey % 2) AS database, n_name AS t FROM nation WHERE n_nationkey % 2 = 1), m AS (SELECT database, count(*) FILTER (WHERE s_nationkey IS NULL) AS missing FROM o JOIN nation ON t = n_name LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey GROUP BY database)
    SELECT database, CASE WHEN (SELECT count(*) FROM m) > 1 THEN 'warning: several databases' WHEN missing > 0 THEN 'warning: tables are missing' ELSE 'alias' END AS verdict FROM m""",
)
def renamed_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    named = n.select(F.concat(F.lit("db"), (F.col("n_nationkey") % 2).cast("string")).alias("database"), F.col("n_name").alias("table"))
    there = n.join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("table"))
    return advisor.renamed(named, there, "db0")


ROLE_SQL = "CASE l_linenumber % 5 WHEN 0 THEN 'eq' WHEN 1 THEN 'range' WHEN 2 THEN 'sort' WHEN 3 THEN 'output' ELSE 'foreign_sort' END"


@register(
    "needs_of_reads",
    f"""WITH c AS (SELECT l_orderkey AS a, {ROLE_SQL} AS role, 'c' || (l_partkey % 4) AS col, l_linenumber AS nth, l_orderkey % 3 = 0 AS lookup FROM lineitem), k AS (SELECT * FROM c WHERE NOT (lookup AND role IN ('eq', 'range'))),
    d AS (SELECT a, role, col, min(nth) AS met FROM k GROUP BY a, role, col), g AS (SELECT a, coalesce(list(col ORDER BY met, col) FILTER (WHERE role = 'eq'), []) AS eq, coalesce(list(col ORDER BY met, col) FILTER (WHERE role = 'range'), []) AS ranges,
      coalesce(list(col ORDER BY met, col) FILTER (WHERE role = 'sort'), []) AS sorts, coalesce(list(col ORDER BY met, col) FILTER (WHERE role = 'output'), []) AS outputs, count(*) FILTER (WHERE role = 'foreign_sort') AS alien FROM d GROUP BY a)
    SELECT a AS access_id, array_to_string(eq, ',') AS eq, array_to_string(list_filter(ranges, lambda x: NOT list_contains(eq, x)), ',') AS ranges, CASE WHEN alien = 0 THEN array_to_string(sorts, ',') ELSE '' END AS sorts, array_to_string(outputs, ',') AS outputs FROM g""",
)
def needs_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    accesses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("access_id"), F.expr("o_orderkey % 3 = 0").alias("is_lookup"))
    columns = li.select(F.col("l_orderkey").alias("access_id"), F.expr(ROLE_SQL).alias("role"), F.concat(F.lit("c"), (F.col("l_partkey") % 4).cast("string")).alias("column"), F.col("l_linenumber").alias("nth"))
    out = advisor.needs(accesses, columns)
    return out.select("access_id", *[F.array_join(c, ",").alias(c) for c in ("eq", "ranges", "sorts", "outputs")])
