"""Requests that nothing blocks have a null blocker; most have, so they may not be joined by it as a whole."""

from pyspark.sql import functions as F

from opsloom.plans import diagnostics as D


def tables(spark):
    r = spark.range(1, 2001).select(
        F.col("id").alias("session_id"), F.lit("DBCC").alias("command"), F.lit("x").alias("status"), F.timestamp_seconds(2000 - F.col("id")).alias("start_time"), F.lit(0.0).alias("percent_complete"),
        F.lit("w").alias("wait_type"), F.lit(1).alias("wait_time"), F.when(F.col("id") % 500 == 0, F.col("id") - 1).otherwise(0).alias("blocking_session_id"),
    )
    s = spark.range(1, 2001).select(F.col("id").alias("session_id"), F.lit("s").alias("status"), F.concat(F.lit("u"), F.col("id")).alias("login_name"), F.col("id").alias("open_transaction_count"))
    return r, s


def test_first_rows_are_taken_before_the_left_joins(spark):
    out = D.maintenance_in_progress(*tables(spark), "2026-01-01", 7, most=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("GlobalLimit") > plan.rindex("LeftOuter")  # the last join's input is told after it
    got = [(r["session_id"], r["blocking_session_id"], r["blocker_open_transactions"], r["blocks_count"]) for r in out.collect()]
    assert got == [(2000, 1999, 1999, 0), (1999, None, None, 1), (1998, None, None, 0)]


def test_a_blocker_with_several_rows_keeps_the_limit(spark):
    r, s = tables(spark)
    twice = r.union(r.where("session_id = 1999"))
    got = [x["session_id"] for x in D.maintenance_in_progress(twice, s, "2026-01-01", 7, most=4).collect()]
    assert got == [2000, 2000, 1999, 1999]
