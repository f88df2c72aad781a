"""Structured Streaming over a growing log: counts of message signatures in windows, with late lines bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.scalar import signature

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the event files that appear under ``path``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def signature_counts(entries: DataFrame, time: str = "time", text: str = "text", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries by window and signature; entries later than ``late`` behind the newest are left out."""
    keyed = entries.withWatermark(time, late).groupBy(F.window(time, size), signature(F.col(text)).alias("sig"))
    return keyed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "sig", "n")
