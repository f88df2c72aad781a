"""Shared helpers: tables cut from their lineage, fixed-size bitmaps, connected components, Arrow batches."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words.
WORD_SEPARATORS = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{WORD_SEPARATORS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (one process on one machine, as in tests) gets a temporary folder; on a
    cluster it is an error, as no machine could read what another wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opsloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes in an Arrow batch, about: what a worker gets or gives at once, whatever the rows' length (one row at least).
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings of multi-job operators: small Arrow batches; shuffle files go when the job that made them ends.

    They stay set: results are worked out after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def named(column: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_id(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a row's key and text: what repeats both shares them. Never null."""
    same = (key.isNull(), key, text)
    return F.xxhash64(*same), F.xxhash64(F.lit("row"), *same)


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/opsloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote for these tables; nothing that is still to be worked out may read them."""
    for table in tables:
        if path := _folders.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, after: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; None for no rows. ``after`` is called when a task ends.

    Workers outlive their tasks, so what a task remembered goes with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
        if after is not None:
            after()
        pa.default_memory_pool().release_unused()

    # Numbered, as dots in names are taken for fields on the way; ``fn`` goes by position.
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap holding the one long column of ``hashes`` (taken modulo its size): eight bits a hash, at least.

    It follows the input up to ``2**MOST_BITS`` bits: so far it may be sent to the driver and broadcast. It only ever
    narrows a search, and what passes is joined exactly afterwards, so a full bitmap costs time, never results.
    """
    hashes = saved(hashes)
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(8 * max(hashes.count(), 1)))))
    at = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark counts a bitmap's positions from 1
    # Rows of PIECE bytes, not of a word: the driver gets little more than the bitmap itself.
    pieces = (
        hashes.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("position"))
        .repartition("piece")
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for piece, held in zip(pieces["piece"].to_pylist(), pieces["bits"]):
        out[(piece - 1) * PIECE : piece * PIECE] = np.frombuffer(held.as_buffer(), dtype=np.uint8)
    discarded(hashes)
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (int64 or uint64) may be in the bitmap."""
    h = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


#: A bitmap has 32 MB at most.
MOST_BITS = 28
#: Bytes in each of Spark's bitmaps; their bits are numbered from the lowest of the first byte.
PIECE = 4096
#: Keys that hold more than such a part of a table's rows are hot; so there are no more of them than this.
MOST_HOT = 4096


#: Neighbours of a node from which on its edges are dealt out among tasks.
HOT_DEGREE = 10_000


def hot_join(rows: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (a row a key, of fixed length; ``count`` tells the key's rows) on ``key``.

    Hot keys, MOST_HOT at most, are joined by broadcast where their rows are; only the others' rows are shuffled, so
    no task gets more than a small part of the rows of a key. All rows are kept; ``count`` is left out. ``counted``
    is read some times over: a saved table.
    """
    told = counted.agg(F.sum(count).alias("total"), F.max(count).alias("top")).first()
    least = max((told["total"] or 0) // MOST_HOT, 100)
    if (told["top"] or 0) <= least:
        return rows.join(counted.drop(count), key)
    hot = F.broadcast(counted.where(F.col(count) > least).drop(count))  # total / least rows at most
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counted.where(F.col(count) <= least).drop(count), key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b of one orderable type): rows (node, component), component the least node.

    Alternates large-star and small-star steps; each round is written to the shared folder, and the one before deleted.
    Both steps take only minima over a node's neighbours, which are combined before they are shuffled, and join them to
    the edges; where a node has over HOT_DEGREE neighbours, those of hot centres by broadcast. Nodes without an edge to another node have no row.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        hot = degree > HOT_DEGREE  # then what is joined is written first, as it is read some times over
        keep = saved if hot else lambda df: df
        join = hot_join if hot else lambda rows, counted, key, count: rows.join(counted.drop(count), key)
        least = keep(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = keep(join(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        nearest = keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        then = saved(join(large, nearest, "a", "n").select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct())
        discarded(now, least, large, nearest)
        now = then
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == last:
            break
        last = seen
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
