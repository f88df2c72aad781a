"""Results with a cap on their rows and the true count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Bounded:
    """``rows`` has ``max_rows`` rows at most; ``row_count`` counts all; ``truncated`` tells whether some are missing."""

    rows: DataFrame
    row_count: int
    truncated: bool


def bounded(df: DataFrame, order: list[Column], max_rows: int = 50) -> Bounded:
    """The first rows in ``order``, with the count of all; a cap of 0 or less is none."""
    n = df.count()
    rows = df.orderBy(*order)
    return Bounded(rows.limit(max_rows) if max_rows > 0 else rows, n, 0 < max_rows < n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "seq") -> DataFrame:
    """The first n rows of each group, numbered from 1; Spark prunes each task's groups before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top_of_several(df: DataFrame, key: str, metrics: list[str], n: int) -> DataFrame:
    """Rows among the first n by any of ``metrics`` (ties to the lower key), once each."""
    parts = [df.orderBy(F.desc_nulls_last(m), key).limit(n).select(key) for m in metrics]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.union(p)
    return df.join(F.broadcast(ids.distinct()), key, "left_semi")  # n * len(metrics) keys at most


def nearest_names(names: DataFrame, column: str, wanted: str, most: int = 3) -> DataFrame:
    """Names within an edit distance of half the length of ``wanted`` plus 2, the nearest first."""
    d = F.levenshtein(F.lower(F.col(column)), F.lit(wanted.lower()))
    return names.select(column, d.alias("distance")).where(F.col("distance") <= len(wanted) // 2 + 2).orderBy("distance", column).limit(most)


def or_sentinel(df: DataFrame, **values: object) -> DataFrame:
    """``df``, or one row of ``values`` (null in other columns) where it is empty."""
    types = dict(df.dtypes)
    row = df.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(types[c]).alias(c) for c in df.columns])
    empty = df.limit(1).agg(F.count("*").alias("__n")).where("__n = 0")
    return df.unionByName(row.join(F.broadcast(empty)).select(*df.columns))


def writes_and_top_reads(df: DataFrame, is_write: Column, order: list[Column], most: int) -> DataFrame:
    """All writes, and the first ``most`` reads in ``order``."""
    return df.where(is_write).unionByName(df.where(~is_write).orderBy(*order).limit(most))


def capped_lists(df: DataFrame, keys: list[str], value: str, order: str, most: int) -> DataFrame:
    """Per group its first ``most`` values as a list, and how many there are in all: the cap never stops the count."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = df.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", F.col(value).alias("v")))).alias("kept"))
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))  # combined before the shuffle
    return counted.join(first, keys, "left").select(*keys, "n", F.transform("kept", lambda x: x["v"]).alias("kept"), (F.col("n") > most).alias("truncated"))
