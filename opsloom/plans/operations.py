"""Registered queries of the operations-data operators, over the driver's tables, each with its oracle SQL.

The tables stand for operations data: events for a server log, orders and lineitem for a workload with its intervals,
part and supplier for a catalogue of objects, customer for snapshots of definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.functions import scalar as S
from opsloom.operators import advisor, bounded, digest, matching, union
from opsloom.plans.registry import register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    """Money as a decimal, so that sums do not depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def total(column: str):
    return F.sum(money(column)).cast("double")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

LOG_SQL = "SELECT event_id AS seq, ts AS time, 'spid' || user_id AS source, event_type || ' for user ' || user_id || ' from 10.0.' || (user_id % 256) || '.7 code 0x' || printf('%x', event_id) || ' props ' || props AS text FROM events"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(
        "event_type", F.lit(" for user "), "user_id", F.lit(" from 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7 code 0x"),
        F.lower(F.hex("event_id")), F.lit(" props "), "props",
    )
    return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), F.concat(F.lit("spid"), "user_id").alias("source"), text.alias("text"))


SIGNATURE_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<guid>', 'g'), "
    "'0x[0-9a-fA-F]+', '<hex>', 'g'), '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '<ip>', 'g'), '[0-9]+', '<n>', 'g')"
)


# -- log digest


@register(
    "signature_rollup",
    f"SELECT sig, count(*) AS n, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_time, arg_min(text, seq) AS text, min(seq) AS first_seq "
    f"FROM (SELECT *, 'spid|' || {SIGNATURE_SQL} AS sig FROM ({LOG_SQL})) GROUP BY sig",
)
def signature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digest.roll_up(log(spark, sf_dir))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_time", "last_time")})


RULES = [
    digest.Rule("level", "severity", "props .*: ([0-9]+)"),
    digest.Rule("purchase", "signal", "^purchase .* 9"),
    digest.Rule("clicks", "noise", "^click"),
    digest.Rule("views", "noise", "^view"),
    digest.Rule("round", "noise", "user [0-9]*0 "),
]
CLASSIFIED_SQL = f"""
SELECT *, CASE WHEN try_cast(regexp_extract(text, 'props .*: ([0-9]+)', 1) AS INT) >= 90 OR regexp_matches(text, '^purchase .* 9') THEN NULL
               WHEN regexp_matches(text, '^click') THEN 'clicks' WHEN regexp_matches(text, '^view') THEN 'views'
               WHEN regexp_matches(text, 'user [0-9]*0 ') THEN 'round' END AS dropped
FROM ({LOG_SQL})"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumn("dropped", digest.verdict(F.col("text"), RULES, 90))


@register("rule_classification", f"SELECT coalesce(dropped, 'kept') AS category, count(*) AS n, min(seq) AS first_seq FROM ({CLASSIFIED_SQL}) GROUP BY 1")
def rule_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy(F.coalesce("dropped", F.lit("kept")).alias("category")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@register("log_counters", f"SELECT count(*) AS total, count(*) FILTER (WHERE dropped IS NULL) AS kept, count(dropped) AS dropped FROM ({CLASSIFIED_SQL})")
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.counters(classified(spark, sf_dir))


@register(
    "advisories",
    f"SELECT dropped AS category, 'seen ' || count(*) || ' times' AS message FROM ({CLASSIFIED_SQL}) WHERE dropped IN ('clicks', 'round') GROUP BY dropped HAVING count(*) >= CASE dropped WHEN 'clicks' THEN 10 ELSE 100000000 END",
)
def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = classified(spark, sf_dir).where("dropped is not null").groupBy(F.col("dropped").alias("category")).agg(F.count("*").alias("n"))
    advice = spark.createDataFrame([("clicks", 10, "seen {n} times"), ("round", 100_000_000, "seen {n} times")], "category string, min_count long, template string")
    return digest.advisories(counted, advice)


@register("time_window", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20') GROUP BY event_type")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(digest.in_window(F.col("ts"), "2024-01-10", "2024-01-20"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register(
    "redaction",
    f"""WITH l AS ({LOG_SQL}), u AS (SELECT regexp_extract(text, 'user ([0-9]+)', 1) AS v, min(seq) AS first_at FROM l GROUP BY 1),
    r AS (SELECT v, '<user_' || row_number() OVER (ORDER BY first_at, v) || '>' AS token FROM u)
    SELECT seq, regexp_replace(text, '(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])', '\\1' || token || '\\2', 'g') AS text FROM l JOIN r ON v = regexp_extract(text, 'user ([0-9]+)', 1)""",
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.redact(log(spark, sf_dir), {"user": "user ([0-9]+)"}).select("seq", "text")


@register(
    "first_last_by_position",
    "SELECT user_id, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_time FROM events WHERE ts IS NOT NULL GROUP BY user_id",
)
def first_last_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts is not null").groupBy("user_id")
    return e.agg(*[F.date_format(f("ts", "event_id"), "yyyy-MM-dd HH:mm:ss").alias(n) for f, n in ((F.min_by, "first_time"), (F.max_by, "last_time"))])


@register(
    "sessionised_entries",
    """SELECT user_id, entry, count(*) AS n_lines, min(event_id) AS first_id, sum(CAST(value * 100 AS BIGINT)) AS cents FROM (
         SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS entry FROM events) GROUP BY user_id, entry""",
)
def sessionised_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("entry", F.sum((F.col("event_type") == "signup").cast("int")).over(by))
    return e.groupBy("user_id", "entry").agg(F.count("*").alias("n_lines"), F.min("event_id").alias("first_id"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


# -- filters and predicates


@register(
    "interval_overlap",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-06-01' GROUP BY o_orderpriority",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate + interval 30 days > timestamp '1997-01-01' and o_orderdate < timestamp '1997-06-01'")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@register(
    "reason_chain",
    """SELECT coalesce(reason, 'keep') AS reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'few' WHEN l_discount = 0 THEN 'no discount' WHEN l_returnflag = 'R' THEN 'returned' END AS reason FROM lineitem) GROUP BY 1""",
)
def reason_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = S.first_reason((F.col("l_quantity") < 5, "few"), (F.col("l_discount") == 0, "no discount"), (F.col("l_returnflag") == "R", "returned"))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(reason, F.lit("keep")).alias("reason")).agg(F.count("*").alias("n"))


@register(
    "reason_list",
    """SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END), '') AS reasons FROM part""",
)
def reason_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.reasons((F.col("p_size") > 40, "large"), (F.col("p_retailprice") > 1000, "dear"), (F.col("p_type") == "ECONOMY", "economy"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("reasons"))


@register("glob_filter", "SELECT p_name, count(*) AS n FROM part WHERE regexp_matches(lower(p_name), '^[^/]*ring$') GROUP BY p_name")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(S.glob_match(F.col("p_name"), "*RING")).groupBy("p_name").agg(F.count("*").alias("n"))


@register("literal_like", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('Red'))")
def literal_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(S.literal_like(F.col("p_name"), F.lit("Red"))).select("p_partkey", "p_name")


@register(
    "like_flags",
    "SELECT p_partkey, CAST(p_name ILIKE '%red%' AS INT) AS is_red, CAST(p_name ILIKE '%ring%' AS INT) AS is_ring, CAST(p_type ILIKE 'eco%' AS INT) AS is_economy FROM part",
)
def like_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, p: F.col(c).ilike(p).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", flag("p_name", "%red%").alias("is_red"), flag("p_name", "%ring%").alias("is_ring"), flag("p_type", "eco%").alias("is_economy"))


@register("parameter_sentinel", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE 0 = 1 OR o_custkey = 7 GROUP BY o_orderstatus")
def parameter_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return spark.sql("select o_orderstatus, count(*) as n from {o} where :all = 1 or o_custkey = :key group by o_orderstatus", {"all": 0, "key": 7}, o=o)


@register(
    "tri_state_verdict",
    """SELECT c_custkey, CASE WHEN o.bad > 0 THEN 'NOT_OK' WHEN o.c IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS verdict
       FROM customer LEFT JOIN (SELECT o_custkey AS c, count(*) FILTER (WHERE o_totalprice > 450000) AS bad FROM orders GROUP BY 1) o ON c = c_custkey""",
)
def tri_state_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count_if(F.col("o_totalprice") > 450000).alias("bad"))
    verdict = F.when(F.col("bad") > 0, "NOT_OK").when(F.col("c").isNull(), "UNKNOWN").otherwise("OK")
    return table(spark, sf_dir, "customer").join(o, F.col("c") == F.col("c_custkey"), "left").select("c_custkey", verdict.alias("verdict"))


# -- joins


@register(
    "join_inner",
    f"SELECT n_name, count(*) AS n, {MONEY.format('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pre-aggregated by customer: the join with orders carries a row for each customer, not for each order.
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("m"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("m").cast("double").alias("revenue"))


@register(
    "left_join_on_predicate",
    "SELECT c_custkey, count(o_orderkey) AS n_urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY c_custkey",
)
def left_join_on_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_urgent"))


@register(
    "self_join_nullable",
    """WITH s AS (SELECT s_suppkey, nullif(s_suppkey % 5, 0) AS blocker FROM supplier)
       SELECT a.s_suppkey, b.s_suppkey AS blocker, c.s_suppkey AS root FROM s a LEFT JOIN s b ON a.blocker = b.s_suppkey LEFT JOIN s c ON b.blocker = c.s_suppkey""",
)
def self_join_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif(F.col("s_suppkey") % 5, F.lit(0)).alias("blocker"))
    out = s.alias("a").join(s.alias("b"), F.col("a.blocker") == F.col("b.s_suppkey"), "left").join(s.alias("c"), F.col("b.blocker") == F.col("c.s_suppkey"), "left")
    return out.select(F.col("a.s_suppkey").alias("s_suppkey"), F.col("b.s_suppkey").alias("blocker"), F.col("c.s_suppkey").alias("root"))


@register(
    "context_row",
    "SELECT n_name, n_suppliers, CAST(n_suppliers AS DOUBLE) / total AS share FROM (SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) CROSS JOIN (SELECT count(*) AS total FROM supplier)",
)
def context_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    by = s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_suppliers"))
    one = s.agg(F.count("*").alias("total"))
    return by.join(F.broadcast(one)).select("n_name", "n_suppliers", (F.col("n_suppliers") / F.col("total")).alias("share"))


@register("semi_join_exists", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment")
def semi_join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@register("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@register(
    "lateral_findings",
    "SELECT p_partkey, 'size' AS finding, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice > 950",
)
def lateral_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(
        F.array(
            F.when(F.col("p_size") > 45, F.struct(F.lit("size").alias("finding"), F.col("p_size").cast("double").alias("value"))),
            F.when(F.col("p_retailprice") > 950, F.struct(F.lit("price").alias("finding"), F.col("p_retailprice").alias("value"))),
        )
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("f")).select("p_partkey", "f.finding", "f.value")


LATEST_SQL = "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey"


@register("latest_per_key", LATEST_SQL)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@register("name_resolution", "SELECT lower(p_name) AS name, min(p_partkey) AS object_id, count(*) AS holders FROM part GROUP BY 1")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("object_id"), F.count("*").alias("holders"))


@register(
    "name_mention_join",
    "SELECT p_partkey, w AS word, n_nationkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) JOIN (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' ELSE 'red' END AS alias FROM nation) ON alias = w",
)
def name_mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    alias = F.when(F.col("n_nationkey") % 3 == 0, "ring").when(F.col("n_nationkey") % 3 == 1, "widget").otherwise("red")
    return words.join(table(spark, sf_dir, "nation").select("n_nationkey", alias.alias("word")), "word").select("p_partkey", "word", "n_nationkey")


_COPY = ["p_name", "p_brand", "p_size"]


@register(
    "null_safe_match",
    """WITH r AS (SELECT p_partkey, p_name, nullif(p_brand, 'Brand#1') AS p_brand, p_size FROM part WHERE p_partkey % 3 = 0),
       c AS (SELECT p_name, nullif(p_brand, 'Brand#1') AS p_brand, p_size FROM part WHERE p_partkey % 3 <> 1)
       SELECT p_partkey, n AS matches, CASE WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'exact_once' ELSE 'exact_many' END AS verdict
       FROM (SELECT p_partkey, (SELECT count(*) FROM c WHERE c.p_name IS NOT DISTINCT FROM r.p_name AND c.p_brand IS NOT DISTINCT FROM r.p_brand AND c.p_size IS NOT DISTINCT FROM r.p_size) AS n FROM r)""",
)
def null_safe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#1")))
    return matching.null_safe_match(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 3 <> 1"), "p_partkey", _COPY)


@register(
    "partial_match",
    """WITH r AS (SELECT p_partkey, p_name, p_brand, p_size + (p_partkey % 2) AS p_size, p_retailprice FROM part WHERE p_partkey % 3 = 0)
       SELECT r.p_partkey, c.p_partkey AS candidate FROM r JOIN part c ON r.p_name = c.p_name AND r.p_retailprice = c.p_retailprice
       WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_name = r.p_name AND x.p_brand = r.p_brand AND x.p_size = r.p_size)""",
)
def partial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    broken = p.where("p_partkey % 3 = 0").withColumn("p_size", (F.col("p_size") + F.col("p_partkey") % 2).cast("int"))
    return matching.partial_match(broken, p, "p_partkey", _COPY, ["p_name", "p_retailprice"], "p_partkey")


# -- aggregation


@register(
    "weighted_totals",
    """SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS weighted_cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
       CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / nullif(sum(CAST(l_quantity AS BIGINT)), 0) AS mean_cents FROM lineitem GROUP BY l_partkey""",
)
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, cents = F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(q * cents).alias("weighted_cents"), F.sum(q).alias("quantity"))
    return by.withColumn("mean_cents", S.ratio(F.col("weighted_cents").cast("double"), F.col("quantity")))


@register("global_period", "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def global_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").agg(day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"), F.count("*").alias("n"))


@register(
    "largest_tables",
    """SELECT l_suppkey, count(*) AS row_count, CAST(sum(CASE WHEN l_linenumber IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS base_rows, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey""",
)
def largest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows of (supplier, part) first: the distinct count then needs no second copy of the rows.
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber").isin(1, 2)).alias("b"))
    return by.groupBy("l_suppkey").agg(F.sum("n").alias("row_count"), F.sum("b").alias("base_rows"), F.count("l_partkey").alias("n_parts"))


@register(
    "existence_flags",
    "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS any_open, max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS any_large FROM orders GROUP BY o_custkey",
)
def existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(flag(F.col("o_orderstatus") == "O").alias("any_open"), flag(F.col("o_totalprice") > 400000).alias("any_large"))


@register(
    "pivot_attributes",
    "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey",
)
def pivot_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return by.na.fill(0, ["F", "O", "P"])


@register(
    "pick_row_beside_totals",
    f"SELECT o_custkey, count(*) AS n, {MONEY.format('o_totalprice')} AS spent, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority FROM orders GROUP BY o_custkey",
)
def pick_row_beside_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), total("o_totalprice").alias("spent"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"))


@register("scalar_aggregate_empty", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey < 0")
def scalar_aggregate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@register("uniform_or_mixed", "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE 'MIXED' END AS status FROM orders GROUP BY o_custkey")
def uniform_or_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = F.min("o_orderstatus"), F.max("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(lo == hi, lo).otherwise("MIXED").alias("status"))


@register("ordered_list", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') within group (order by n_nationkey)").alias("names"))


@register("distinct_list", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


# -- windows, order, limits


@register("rank_of_groups", "SELECT row_number() OVER (ORDER BY n DESC, c_mktsegment) AS place, c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ORDER BY place LIMIT 3")
def rank_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(3)
    return by.select(F.row_number().over(Window.orderBy(F.desc("n"), "c_mktsegment")).alias("place"), "c_mktsegment", "n")  # over three rows


@register("top_k_per_group", "SELECT o_custkey, o_orderkey, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS seq FROM orders) WHERE seq <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "seq")


@register("collisions", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY lower(p_name)) AS holders FROM part")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.count("*").over(Window.partitionBy(F.lower("p_name"))).alias("holders"))


@register("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@register(
    "top_of_several",
    """WITH w AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity, max(l_extendedprice) AS price FROM lineitem GROUP BY 1)
       SELECT l_orderkey, n FROM w WHERE l_orderkey IN ((SELECT l_orderkey FROM w ORDER BY n DESC, 1 LIMIT 50) UNION (SELECT l_orderkey FROM w ORDER BY quantity DESC, 1 LIMIT 50) UNION (SELECT l_orderkey FROM w ORDER BY price DESC, 1 LIMIT 50))""",
)
def top_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_extendedprice").alias("price"))
    return bounded.top_of_several(w, "l_orderkey", ["n", "quantity", "price"], 50).select("l_orderkey", "n")


@register("bounded_result", "SELECT o_orderkey, total FROM (SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderkey LIMIT 20")
def bounded_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bounded.bounded(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), [F.asc("o_orderkey")], 20)
    return out.rows.withColumn("total", F.lit(out.row_count).cast("long"))


@register("nearest_names", "SELECT n_name, CAST(levenshtein(lower(n_name), 'naton_11') AS INT) AS distance FROM nation WHERE levenshtein(lower(n_name), 'naton_11') <= 6 ORDER BY distance, n_name LIMIT 3")
def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded.nearest_names(table(spark, sf_dir, "nation"), "n_name", "NATON_11")


# -- sets


@register("union_distinct", "SELECT p_partkey FROM part WHERE p_size > 25 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey").union(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")).distinct()


@register(
    "tagged_union",
    "SELECT 'customer' AS row_kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2",
)
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).select(F.lit(t).alias("row_kind"), "nation", "n")
    return part("customer", "c_nationkey").unionByName(part("supplier", "s_nationkey"))


@register(
    "union_sentinel",
    "WITH big AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000), none AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 0) "
    "SELECT * FROM big UNION ALL SELECT NULL, 'none' WHERE NOT EXISTS (SELECT 1 FROM big) UNION ALL SELECT * FROM none UNION ALL SELECT NULL, 'none' WHERE NOT EXISTS (SELECT 1 FROM none)",
)
def union_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = [bounded.or_sentinel(o.where(w).select("o_orderkey", "o_orderstatus"), o_orderstatus="none") for w in ("o_totalprice > 1000", "o_totalprice < 0")]
    return parts[0].unionByName(parts[1])


@register("except_rows", "SELECT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def except_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_nationkey", "c_mktsegment").subtract(c.where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment"))


@register("fleet_union", "SELECT 'a' AS source, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'b', r_regionkey, r_name FROM region")
def fleet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("k"), F.col(n).alias("name"))
    found = union.unite(
        {"a": lambda: pick("nation", "n_nationkey", "n_name"), "b": lambda: pick("region", "r_regionkey", "r_name"), "c": lambda: pick("supplier", "s_suppkey", "s_name"), "d": lambda: pick("absent", "k", "name")}
    )
    return found.rows


# -- scalar functions


@register(
    "int_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 AS BIGINT) AS seconds FROM orders""",
)
def int_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    packed = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("d"), ((k % 24) * 10000 + (k % 60) * 100 + k % 59).alias("t"))
    return packed.select("o_orderkey", F.date_format(S.int_date(F.col("d")), "yyyy-MM-dd").alias("day"), S.int_time_seconds(F.col("t")).cast("long").alias("seconds"))


@register("quoted_names", "SELECT p_partkey, '[' || replace(p_brand || ']x', ']', ']]') || ']' AS quoted, substr(sha256(p_name), 1, 12) AS id FROM part")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.quote_name(F.concat("p_brand", F.lit("]x"))).alias("quoted"), S.short_hash(F.col("p_name")).alias("id"))


@register(
    "guarded_numbers",
    """SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS per_line, CAST(l_quantity AS BIGINT) // 7 AS sevens, CAST(l_quantity AS BIGINT) % 7 AS rest,
       greatest(ceil(l_quantity * (l_linenumber + 10) / 8096), 1) AS pages FROM lineitem""",
)
def guarded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.ratio(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("per_line"), F.expr("cast(l_quantity as bigint) div 7").alias("sevens"),
        (q % 7).alias("rest"), S.estimated_pages(F.col("l_quantity"), F.col("l_linenumber")).cast("double").alias("pages"),
    )


@register(
    "seconds_between_events",
    "SELECT event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS seconds FROM events",
)
def seconds_between_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = table(spark, sf_dir, "events").withColumn("before", before)
    return t.select("event_id", S.seconds_between(F.col("before").cast("timestamp"), F.col("ts").cast("timestamp")).alias("seconds"))


@register("option_bits", "SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey & 1 <> 0 THEN 'A' END, CASE WHEN c_custkey & 2 <> 0 THEN 'B' END, CASE WHEN c_custkey & 4 <> 0 THEN 'C' END) AS options FROM customer")
def option_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n, name: F.when(F.col("c_custkey").bitwiseAND(n) != 0, name)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", bit(1, "A"), bit(2, "B"), bit(4, "C")).alias("options"))


@register("excerpts", "SELECT conv_id, turn, substr(replace(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), '`', ''''), 1, 100) AS excerpt FROM conversations")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.excerpt(F.col("text")).alias("excerpt"))


# -- index advice


@register(
    "workload_rollup",
    """SELECT l_partkey AS query_id, CAST(sum(l_linenumber) AS BIGINT) AS executions, strftime(min(l_shipdate), '%Y-%m-%d') AS first_start, strftime(max(l_shipdate + INTERVAL 1 HOUR), '%Y-%m-%d %H') AS last_end
       FROM lineitem WHERE l_shipdate + INTERVAL 1 HOUR > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1""",
)
def workload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("executions"), F.col("l_shipdate").alias("interval_start"), F.expr("l_shipdate + interval 1 hour").alias("interval_end"),
        F.col("l_extendedprice").alias("avg_cpu"), F.col("l_quantity").alias("avg_reads"), F.col("l_tax").alias("avg_rows"),
    )
    out = advisor.workload(i, "1996-01-01", "1999-01-01")
    return out.select("query_id", "executions", F.date_format("first_start", "yyyy-MM-dd").alias("first_start"), F.date_format("last_end", "yyyy-MM-dd HH").alias("last_end"))


@register(
    "candidate_merge",
    """WITH c AS (SELECT o_custkey % 50 AS table_id, o_orderkey AS query_id, o_orderkey % 5 AS a, 5 + o_orderkey % 3 AS b, 10 + o_orderkey % 4 AS i FROM orders),
       m AS (SELECT table_id, a, b, count(*) AS needs, count(DISTINCT query_id) AS n_queries, string_agg(DISTINCT i::VARCHAR, ',' ORDER BY i::VARCHAR) AS includes FROM c GROUP BY 1, 2, 3)
       SELECT table_id, a || ',' || b AS keys, includes, n_queries, needs, substr(sha256(table_id || '|' || a || ',' || b || '|' || includes), 1, 12) AS candidate_id FROM m""",
)
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<int>")
    needs = table(spark, sf_dir, "orders").select(
        k.alias("need_id"), k.alias("query_id"), (F.col("o_custkey") % 50).alias("table_id"), F.array((k % 5).cast("int")).alias("eq"), F.array((5 + k % 3).cast("int")).alias("ranges"), none.alias("sort"),
        F.array((10 + k % 4).cast("int")).alias("output"),
    )
    out = advisor.merged(advisor.candidates(needs))
    return out.select("table_id", F.array_join("keys", ",").alias("keys"), F.array_join("includes", ",").alias("includes"), F.size("queries").cast("long").alias("n_queries"), "needs", "candidate_id")


@register(
    "candidate_scores",
    """WITH m AS (SELECT l_orderkey AS query_id, l_suppkey AS candidate_id, CAST(round(l_extendedprice) AS BIGINT) AS b, CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS m FROM lineitem),
       s AS (SELECT candidate_id, coalesce(sum(CASE WHEN query_id % 4 <> 0 THEN b - a END), 0) AS gain, coalesce(sum(CASE WHEN query_id % 4 = 0 THEN m END), 0) AS maintenance,
                    coalesce(sum(CASE WHEN query_id % 4 <> 0 THEN b END), 0) AS cost_before, count(*) FILTER (WHERE query_id % 4 <> 0) AS measured FROM m JOIN orders ON o_orderkey = query_id GROUP BY 1)
       SELECT candidate_id, CAST(gain AS DOUBLE) AS gain, CAST(maintenance AS DOUBLE) AS maintenance, measured,
              CASE WHEN measured < 1 THEN 'not_evaluated' WHEN coalesce(100.0 * CAST(gain AS DOUBLE) / nullif(cost_before, 0), 0) < 10 THEN 'rejected: low gain' WHEN 100.0 * maintenance > 50.0 * gain THEN 'rejected: high maintenance' ELSE 'recommended' END AS decision FROM s""",
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.round(c).cast("long").cast("double")
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("candidate_id"), whole(F.col("l_extendedprice")).alias("before"), whole(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("after"),
        F.col("l_quantity").cast("long").cast("double").alias("maintenance"), F.lit("ok").alias("status"),
    )
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("executions"), (F.col("o_orderkey") % 4 == 0).alias("is_write"))
    return advisor.scores(m, q).select("candidate_id", "gain", "maintenance", "measured", "decision")


@register(
    "drift",
    """WITH b AS (SELECT c_custkey, c_mktsegment AS d FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'NEW' ELSE c_mktsegment END AS d FROM customer WHERE c_custkey % 11 <> 0)
       SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'created' WHEN a.c_custkey IS NULL THEN 'dropped' ELSE 'changed' END AS change
       FROM b FULL JOIN a ON b.c_custkey = a.c_custkey WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR b.d IS DISTINCT FROM a.d""",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    after = c.where("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 3, "NEW").otherwise(F.col("c_mktsegment")))
    return matching.drift(c.where("c_custkey % 7 <> 0"), after, ["c_custkey"], "c_mktsegment").select("c_custkey", "change")


@register("journal_last_state", "SELECT user_id, arg_max(event_type, event_id) AS state, min(event_id) AS first_seq FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def journal_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "removed").otherwise(F.col("event_type"))
    j = table(spark, sf_dir, "events").select(F.lit("user").alias("kind"), F.col("user_id").alias("name"), state.alias("state"), F.col("event_id").alias("seq"))
    return advisor.last_states(j).select(F.col("name").alias("user_id"), "state", "first_seq")
