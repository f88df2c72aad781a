"""Matching rows against a copy: nulls equal nulls, and what has no exact match is looked up by the intact columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_match(rows: DataFrame, copy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per ``key`` of ``rows``: matches (rows of ``copy`` equal in all columns) and verdict.

    The verdict is exact_once, exact_many or no_match. The copy is counted by its columns first, so a row that stands
    there a million times is one row of the join.
    """
    counted = copy.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.count("*").alias("__n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    n = F.coalesce(F.col("__n"), F.lit(0))
    verdict = F.when(n == 0, "no_match").when(n == 1, "exact_once").otherwise("exact_many")
    return rows.join(counted, same, "left").select(key, n.alias("matches"), verdict.alias("verdict"))


def partial_match(rows: DataFrame, copy: DataFrame, key: str, columns: list[str], intact: list[str], copy_key: str) -> DataFrame:
    """For rows without an exact match: keys of the copy's rows that agree in the ``intact`` columns."""
    exact = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns])
    left = rows.alias("r").join(copy.alias("c"), exact, "left_anti")
    near = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in intact]
    return left.alias("r").join(copy.alias("c"), reduce(lambda a, b: a & b, near)).select(F.col(f"r.{key}").alias(key), F.col(f"c.{copy_key}").alias("candidate"))


def drift(before: DataFrame, after: DataFrame, keys: list[str], definition: str) -> DataFrame:
    """Keys that were created, changed or dropped between two snapshots."""
    b, a = before.select(*keys, F.col(definition).alias("old")), after.select(*keys, F.col(definition).alias("new"))
    both = b.withColumn("__b", F.lit(True)).join(a.withColumn("__a", F.lit(True)), keys, "full")
    change = F.when(F.col("__b").isNull(), "created").when(F.col("__a").isNull(), "dropped").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "old", "new")


def missing_rows(rows: DataFrame, copy: DataFrame) -> int:
    """Distinct rows of ``rows`` that ``copy`` lacks."""
    return rows.subtract(copy).count()
