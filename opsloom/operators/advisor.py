"""Index advice over a workload: roll up, candidates, comparison with what exists, scores.

Tables (all as DataFrames): queries (query_id, executions, cpu_ms, reads, is_write), needs (query_id, table_id, eq, ranges,
sort, output: arrays of column ids), indexes (table_id, index_id, kind, is_unique, is_constraint, keys, includes),
measures (query_id, candidate_id, before, after, maintenance, status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.scalar import ratio

#: Score limits: least gain in per cent, most maintenance in per cent of the gain, least measured queries.
LEAST_GAIN, MOST_MAINTENANCE, LEAST_QUERIES = 10.0, 50.0, 1


def workload(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of each query over the intervals that overlap [start, end); an interval counts as a whole."""
    inside = intervals.where((F.col("interval_end") > F.lit(start).cast("timestamp")) & (F.col("interval_start") < F.lit(end).cast("timestamp")))
    n = F.col("executions")
    return inside.groupBy("query_id").agg(
        F.sum(n).alias("executions"),
        (F.sum(F.col("avg_cpu") * n) / 1000).alias("cpu_ms"),
        F.sum(F.col("avg_reads") * n).alias("reads"),
        ratio(F.sum(F.col("avg_rows") * n), F.sum(n)).alias("avg_rows"),
        F.min("interval_start").alias("first_start"),
        F.max("interval_end").alias("last_end"),
    )


def order_equality(needs: DataFrame, indexes: DataFrame) -> DataFrame:
    """``needs`` with ``eq`` ordered as in the index that begins with most of it (ties: least index_id), the rest by id."""
    pairs = needs.select("need_id", "table_id", "eq").join(indexes.select("table_id", "index_id", "keys"), "table_id")
    prefix = F.aggregate("keys", F.struct(F.lit(True).alias("on"), F.array().cast("array<int>").alias("taken")), _take_prefix(F.col("eq")))["taken"]
    best = pairs.withColumn("prefix", prefix).groupBy("need_id").agg(F.max_by("prefix", F.struct(F.size("prefix"), -F.col("index_id"))).alias("prefix"))
    out = needs.join(best, "need_id", "left").withColumn("prefix", F.coalesce("prefix", F.array().cast("array<int>")))
    return out.withColumn("eq", F.concat("prefix", F.array_sort(F.array_except("eq", "prefix")))).drop("prefix")


def _take_prefix(eq):
    return lambda state, key: F.struct(
        (state["on"] & F.array_contains(eq, key)).alias("on"),
        F.when(state["on"] & F.array_contains(eq, key), F.array_append(state["taken"], key)).otherwise(state["taken"]).alias("taken"),
    )


def candidates(needs: DataFrame) -> DataFrame:
    """One candidate for each need with keys: equality columns, then the sort or else one range column; the rest is included."""
    eq, sort, ranges = F.col("eq"), F.array_except("sort", "eq"), F.array_sort(F.array_except("ranges", "eq"))
    keys = F.concat(eq, F.when(F.size(sort) > 0, sort).otherwise(F.slice(ranges, 1, 1)))
    rest = F.array_sort(F.array_except(F.array_union(F.array_union("output", "ranges"), "sort"), keys))
    return needs.select("need_id", "query_id", "table_id", keys.alias("keys"), rest.alias("includes"), F.size("eq").alias("eq_count")).where(F.size("keys") > 0)


def merged(cands: DataFrame) -> DataFrame:
    """Candidates of equal table and keys as one: includes and queries united, the least equality count; order does not matter."""
    return (
        cands.groupBy("table_id", "keys")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("includes")))).alias("includes"),
            F.array_sort(F.collect_set("query_id")).alias("queries"),
            F.min("eq_count").alias("eq_count"),
            F.count("*").alias("needs"),
        )
        .withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("|", F.col("table_id").cast("string"), F.array_join("keys", ","), F.array_join("includes", ",")), 256), 1, 12))
    )


def effective_keys(indexes: DataFrame, clustered: str = "clustered_keys") -> DataFrame:
    """``indexes`` with ``effective``: a non-unique nonclustered index has the missing keys of the clustered one appended."""
    more = F.array_except(F.coalesce(F.col(clustered), F.array().cast("array<string>")), F.col("keys"))
    return indexes.withColumn("effective", F.when(F.col("is_unique") | (F.col("kind") != "nonclustered"), F.col("keys")).otherwise(F.concat("keys", more)))


def _turned(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.when(k.endswith(" desc"), F.regexp_replace(k, " desc$", "")).otherwise(F.concat(k, F.lit(" desc"))))


def _names(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.regexp_replace(k, " desc$", ""))


def leads(keys: Column, eq_count: Column, ikeys: Column) -> Column:
    """Whether an index's keys begin as a candidate's do: the equality keys in any order, the others as they are or all of them turned.

    Keys are names, with `` desc`` behind one that descends.
    """
    n = F.size(keys)
    equal = F.array_sort(_names(F.slice(ikeys, F.lit(1), eq_count))) == F.array_sort(_names(F.slice(keys, F.lit(1), eq_count)))
    rest, irest = F.slice(keys, eq_count + 1, n - eq_count), F.slice(ikeys, eq_count + 1, n - eq_count)
    return (F.size(ikeys) >= n) & equal & ((irest == rest) | (irest == _turned(rest)))


def confront(cands: DataFrame, indexes: DataFrame) -> DataFrame:
    """Per candidate the first decision that holds: covered, widen or discuss, replace, new; by index_id among equal ones.

    ``eq_count`` of a candidate counts its leading equality keys (none without the column). An index whose keys are a
    strict beginning of the candidate's is replaced unless it is a constraint or, where there is the column, not ``replaceable``.
    """
    eq = F.col("eq_count") if "eq_count" in cands.columns else F.lit(0)
    may = F.col("replaceable") if "replaceable" in indexes.columns else F.lit(True)
    text = lambda c: F.col(c).cast("array<string>")  # noqa: E731  columns may be named by number
    pairs = cands.select("candidate_id", "table_id", text("keys").alias("keys"), text("includes").alias("includes"), F.least(eq, F.size("keys")).cast("int").alias("eq")).join(
        indexes.select("table_id", "index_id", "is_constraint", text("keys").alias("ikeys"), text("includes").alias("iincludes"), may.alias("may")), "table_id", "left"
    )
    same_keys = leads(F.col("keys"), F.col("eq"), F.col("ikeys"))
    covers = same_keys & (F.size(F.array_except(_names(F.array_union("keys", "includes")), _names(F.array_union("ikeys", "iincludes")))) == 0)
    shorter = F.slice("keys", F.lit(1), F.size("ikeys"))
    prefix = (F.size("ikeys") < F.size("keys")) & leads(shorter, F.least(F.col("eq"), F.size("ikeys")), F.col("ikeys"))
    rank = F.when(covers, 0).when(same_keys, 1).when(prefix & ~F.col("is_constraint") & F.col("may"), 2).otherwise(3)
    first = pairs.withColumn("rank", rank).groupBy("candidate_id").agg(
        F.min_by(F.struct("rank", "index_id", "is_constraint"), F.struct("rank", "index_id")).alias("b")
    )
    decision = F.when(F.col("b.rank") == 0, "covered").when((F.col("b.rank") == 1) & F.col("b.is_constraint"), "discuss").when(F.col("b.rank") == 1, "widen").when(F.col("b.rank") == 2, "replace").otherwise("new")
    return first.select("candidate_id", decision.alias("decision"), F.when(F.col("b.rank") < 3, F.col("b.index_id")).alias("index_id"))


def maintenance(writes: DataFrame, base: DataFrame) -> DataFrame:
    """Per write operator with an index (query_id, op, candidate_id, others, only_this, cost) what maintaining it costs.

    Its own cost if it maintains this index only; else what it costs beyond the operator without the index (``base``)
    that does the same with the same other objects, and not less than 0; null where there is none.
    """
    key = ["query_id", "op", F.array_sort("others").alias("others")]
    before = base.select(*key, F.col("cost").alias("base_cost")).groupBy("query_id", "op", "others").agg(F.max("base_cost").alias("base_cost"))
    rows = writes.select(*key, "candidate_id", "only_this", "cost").join(before, ["query_id", "op", "others"], "left")
    return rows.withColumn("maintenance", F.when(F.col("only_this"), F.col("cost")).otherwise(F.greatest(F.col("cost") - F.col("base_cost"), F.when(F.col("base_cost").isNotNull(), F.lit(0.0)))))


def with_caps(scored: DataFrame) -> DataFrame:
    """``scored`` with ``notes``, in this order, and a recommendation that has any of them turned to ``discuss``."""
    notes = F.array_compact(
        F.array(
            F.when(F.col("unmeasured_writes") > 0, "a write is not measured"), F.when(F.col("is_constraint"), "the index is a constraint"),
            F.when(F.col("from_plan_cache"), "executions are of the plan cache"), F.when(F.col("unreliable"), "measures are unreliable"), F.when(F.col("redundant"), "other candidates do as well"),
        )
    )
    out = scored.withColumn("notes", notes)
    return out.withColumn("decision", F.when((F.col("decision") == "recommended") & (F.size("notes") > 0), "discuss").otherwise(F.col("decision")))


def redundant_by_absence(cands: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that none of the measured combinations with them uses (candidate_id, instead): the others used there.

    ``used`` has a row a combination: (combination_id, offered, used), arrays of candidate ids.
    """
    each = used.select(F.explode("offered").alias("candidate_id"), F.col("used").alias("taken"))
    seen = each.withColumn("own", F.array_contains("taken", F.col("candidate_id")))
    out = seen.groupBy("candidate_id").agg(F.bool_or("own").alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("taken")))).alias("instead"))
    return cands.select("candidate_id").join(out.where("not own"), "candidate_id").select("candidate_id", "instead")


def droppable(indexes: DataFrame) -> Column:
    """Whether a script may drop the index: no primary key, nothing unique, nonclustered, and named in no hint or forced plan."""
    named = F.coalesce(F.col("is_hinted"), F.lit(False)) | F.coalesce(F.col("is_forced"), F.lit(False))
    return ~F.col("is_primary") & ~F.col("is_unique") & (F.col("kind") == "nonclustered") & ~named


def renamed(named_tables: DataFrame, tables: DataFrame, own: str) -> DataFrame:
    """The database that a workload of another name means (database, verdict): an alias of ``own`` if it is the only other
    one and all its tables are there; else a warning that says why not.
    """
    other = named_tables.where(F.col("database") != own).select("database", "table").distinct()
    missing = other.join(tables.select("table", F.lit(True).alias("there")).distinct(), "table", "left")
    told = missing.groupBy("database").agg(F.count_if(F.col("there").isNull()).alias("missing"))
    several = told.agg(F.count("*").alias("databases"))
    return told.join(several).select("database", F.when(F.col("databases") > 1, "warning: several databases").when(F.col("missing") > 0, "warning: tables are missing").otherwise("alias").alias("verdict"))


def needs(accesses: DataFrame, columns: DataFrame) -> DataFrame:
    """Per access its needs: equality, range less equality, sort and output columns, each in order and once.

    ``columns`` has (access_id, role, column, nth). A lookup's own seek is by the row's place and no need; a sort
    counts only if all its columns are the access's.
    """
    roles = ("eq", "range", "sort", "output", "foreign_sort")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("nth", "column")))), lambda x: x["column"]).alias(r) for r in roles]
    seek = F.col("is_lookup") & F.col("role").isin("eq", "range")
    rows = accesses.select("access_id", "is_lookup").join(columns, "access_id").where(~seek).groupBy("access_id").agg(*lists)
    empty = F.array().cast("array<string>")
    return rows.select(
        "access_id", F.array_distinct("eq").alias("eq"), F.array_except("range", "eq").alias("ranges"),
        F.when(F.size("foreign_sort") == 0, F.array_distinct("sort")).otherwise(empty).alias("sorts"), F.array_distinct("output").alias("outputs"),
    )


def needs_of_missing_groups(groups: DataFrame) -> DataFrame:
    """Missing-index groups (group_id, eq, inequality, include) in the form of ``needs``."""
    empty = F.array().cast("array<string>")
    return groups.select(
        F.col("group_id").alias("access_id"), F.coalesce("eq", empty).alias("eq"), F.array_except(F.coalesce("inequality", empty), F.coalesce("eq", empty)).alias("ranges"), empty.alias("sorts"), F.coalesce("include", empty).alias("outputs")
    )


class Stale(ValueError):
    """An evaluation belongs to another collection or run."""


def require_run(evaluation: DataFrame, collect_id: str, run_id: str) -> DataFrame:
    """``evaluation`` if all its rows are of this collection and run; else ``Stale``, before anything is joined to it."""
    off = evaluation.where(~(F.col("collect_id").eqNullSafe(F.lit(collect_id)) & F.col("run_id").eqNullSafe(F.lit(run_id)))).limit(1).collect()
    if off:
        raise Stale(f"of {off[0]['collect_id']}, {off[0]['run_id']}, not {collect_id}, {run_id}")
    return evaluation


def scores(measures: DataFrame, queries: DataFrame) -> DataFrame:
    """Per candidate: gain, maintenance, cost before, measured queries, gain in per cent, decision."""
    ok = F.col("status") == "ok"
    read, write = ok & ~F.col("is_write"), ok & F.col("is_write")
    sums = measures.join(queries.select("query_id", "executions", "is_write"), "query_id").groupBy("candidate_id").agg(
        F.coalesce(F.sum(F.when(read, (F.col("before") - F.col("after")) * F.col("executions"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(write, F.col("maintenance") * F.col("executions"))), F.lit(0.0)).alias("maintenance"),
        F.coalesce(F.sum(F.when(read, F.col("before") * F.col("executions"))), F.lit(0.0)).alias("cost_before"),
        F.count_if(read).alias("measured"),
    )
    percent = F.coalesce(100 * ratio(F.col("gain"), F.col("cost_before")), F.lit(0.0))
    decision = (
        F.when(F.col("measured") < LEAST_QUERIES, "not_evaluated")
        .when(F.col("gain_percent") < LEAST_GAIN, "rejected: low gain")
        .when(100 * F.col("maintenance") > MOST_MAINTENANCE * F.col("gain"), "rejected: high maintenance")
        .otherwise("recommended")
    )
    return sums.withColumn("gain_percent", percent).withColumn("decision", decision)


def redundant(indexes: DataFrame) -> DataFrame:
    """Pairs of one table's indexes of which the first adds nothing: equal keys (the later id), or a strict prefix of keys."""
    a, b = indexes.alias("a"), indexes.alias("b")
    pair = a.join(b, (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.index_id") != F.col("b.index_id")))
    same = (F.col("a.keys") == F.col("b.keys")) & (F.col("a.index_id") > F.col("b.index_id"))
    prefix = (F.size("a.keys") < F.size("b.keys")) & (F.slice("b.keys", F.lit(1), F.size("a.keys")) == F.col("a.keys"))
    kind = F.when(same, "same keys").when(prefix, "key prefix")
    return pair.where(~F.col("a.is_constraint")).select(F.col("a.table_id").alias("table_id"), F.col("a.index_id").alias("index_id"), F.col("b.index_id").alias("by_index_id"), kind.alias("kind")).where("kind is not null")


def summary(scored: DataFrame) -> DataFrame:
    """Counts by decision and the gain of what is recommended: one row."""
    return scored.agg(
        F.count_if(F.col("decision") == "recommended").alias("recommended"),
        F.count_if(F.col("decision").startswith("rejected")).alias("rejected"),
        F.count_if(F.col("decision") == "not_evaluated").alias("not_evaluated"),
        F.coalesce(F.sum(F.when(F.col("decision") == "recommended", F.col("gain"))), F.lit(0.0)).alias("recommended_gain"),
    )


def last_states(journal: DataFrame) -> DataFrame:
    """The last state of each object that is not removed, in order of first appearance."""
    by = journal.groupBy("kind", "name").agg(F.max_by("state", "seq").alias("state"), F.min("seq").alias("first_seq"))
    return by.where("state <> 'removed'")


def collisions(entries: DataFrame) -> DataFrame:
    """Catalogue names held more than once: a bundled entry keeps its name, the other holders are rejected (all, if none is)."""
    by = Window.partitionBy(F.lower("name"))
    bundled = (F.col("source") == "bundled").cast("int")
    out = entries.withColumns({"holders": F.count("*").over(by), "has_bundled": F.max(bundled).over(by)})
    reason = F.when((F.col("holders") > 1) & ((F.col("has_bundled") == 0) | (F.col("source") != "bundled")), F.lit("name is taken"))
    return out.withColumn("rejected", reason).drop("holders", "has_bundled")
