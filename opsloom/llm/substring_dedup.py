"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest over the whole corpus.

A chunk ends where the gear hash of the last 16 bytes is low, so chunks depend on content only: text inserted before
a passage shifts the passage's chunks but leaves them as they are. Chunks that occur again are joined to runs. A run is
lengthened at both ends by the bytes around it that equal those around the first occurrence, CONTEXT at most; runs of
``least_bytes`` or more are repeated passages, and all but the first occurrence can be removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import bitmap, hot_join, in_bitmap, map_batches, named, prepare, saved

#: Bytes in a chunk: 2 ** MEAN_BITS on average beyond LEAST, and MOST at most.
MEAN_BITS, LEAST, MOST = 5, 12, 4096
#: A run counts as a repeated passage from so many bytes on: over 50 words have more if they have three letters on average.
LEAST_RUN = 200
#: Bytes around a chunk that are kept to lengthen runs: more than the mean chunk and the bytes that the gear hash needs first.
CONTEXT = 64
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)


def cut_points(data: bytes) -> list[int]:
    """Ends (exclusive) of the chunks of ``data``; never inside a UTF-8 character."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8):  # gear: h[i] = sum of GEAR[byte i - k] << k over the 16 bytes that a 16-bit sum can hold
        later = h.copy()
        later[shift:] += h[:-shift] << np.uint16(shift)
        h = later
    starts = np.ones(n + 1, dtype=bool)  # a cut may stand before byte i
    starts[:n] = (raw & 0xC0) != 0x80
    ends = np.flatnonzero((h >> np.uint16(16 - MEAN_BITS) == 0) & starts[1:]) + 1
    out, at = [], 0
    for end in [*ends.tolist(), n]:
        while end - at > MOST:
            at += MOST
            while not starts[at]:
                at -= 1
            out.append(at)
        if end - at >= LEAST or end == n:
            out.append(end)
            at = end
    return out if out[-1] == n and (len(out) < 2 or out[-2] != n) else list(dict.fromkeys(out))


def _chunks(docs: DataFrame, key: str, text: str, only: np.ndarray | None) -> DataFrame:
    """Rows (k, r, start, size, digest, pre, post) of the chunks whose digest may be in the bitmap ``only``; without it (h) of all.

    ``pre`` and ``post`` are the bytes before and after a chunk, empty where the chunk there is among the rows too.
    """
    t = named(text).cast("string")
    frame = docs.select(named(key).alias("k"), t.alias("t"), F.xxhash64(t).alias("r"))
    kind = frame.schema["k"].dataType.simpleString()
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        digests, spans, owner, raw = [], [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            data = t.encode("utf-8", "surrogatepass") if t else b""
            raw.append(data)
            at = 0
            for end in cut_points(data):
                digests.append(hashlib.blake2b(data[at:end], digest_size=16).digest())
                spans.append((at, end))
                owner.append(i)
                at = end
        if not digests:
            return None
        h = np.frombuffer(b"".join(digests), dtype="<i8")[::2]
        if sent is None:
            return pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
        hit = in_bitmap(sent.value, np.ascontiguousarray(h))
        take = np.flatnonzero(hit).tolist()
        if not take:
            return None
        own = np.array(owner)
        inner = hit[1:] & hit[:-1] & (own[1:] == own[:-1])  # the chunk and the one after it are both here
        before, after = np.r_[False, inner].tolist(), np.r_[inner, False].tolist()
        pre, post = [], []
        for i in take:
            (a, z), data = spans[i], raw[owner[i]]
            pre.append(b"" if before[i] else data[max(0, a - CONTEXT) : a])
            post.append(b"" if after[i] else data[z : z + CONTEXT])
        rows = pa.array(own[take])
        cols = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array([spans[i][0] for i in take], pa.int64()), pa.array([spans[i][1] - spans[i][0] for i in take], pa.int64())]
        cols += [pa.array([digests[i] for i in take], pa.binary()), pa.array(pre, pa.binary()), pa.array(post, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["k", "r", "start", "size", "digest", "pre", "post"])

    return map_batches(frame, cut, "h long" if only is None else f"k {kind}, r long, start long, size long, digest binary, pre binary, post binary")


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two texts share from their beginning, whole UTF-8 characters only."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    while 0 < n < max(len(a), len(b)) and any(n < len(x) and x[n] & 0xC0 == 0x80 for x in (a, b)):
        n -= 1
    return n


def _shared_end(a: bytes, b: bytes) -> int:
    """Bytes that two texts share at their end, whole UTF-8 characters only."""
    n = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    while n and a[len(a) - n] & 0xC0 == 0x80:
        n -= 1
    return n


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_bytes: int = LEAST_RUN) -> DataFrame:
    """Passages that occurred before: (k, start, size, first_k, r), in bytes of the text's UTF-8; r is a hash of the text.

    ``first_k`` is the least key of a text that holds one of the passage's chunks first. The first occurrence of a
    chunk is the one with the least (key, start); it is no row. Null and empty texts have no passage; rows with a null
    key come after all others, each as a text of its own, as do texts that share a key. Rows that repeat both key and
    text count as one. Two passages may share the bytes between them.
    """
    prepare(docs.sparkSession)
    again = _chunks(docs, key, text, None).groupBy("h").count().where("count > 1").select("h")
    found = saved(_chunks(docs, key, text, bitmap(again)))
    far = F.struct(F.col("k").isNull().alias("none"), "k", "start", "r", "pre", "post")
    first = saved(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(far).alias("first")).where("n > 1"))
    repeats = hot_join(found, first, "digest", "n").where("not (k <=> first.k and r = first.r and start = first.start)")
    repeats = repeats.select("k", "r", "start", "size", F.col("first.k").alias("first_k"), "pre", "post", F.col("first.pre").alias("first_pre"), F.col("first.post").alias("first_post"))
    by_text = Window.partitionBy("k", "r").orderBy("start")
    # Rows that repeat key and text have each chunk again, beside it in this order.
    once = repeats.withColumn("copy", F.lag("start").over(by_text).eqNullSafe(F.col("start"))).where("not copy").drop("copy")
    opens = (F.lag(F.col("start") + F.col("size")).over(by_text).eqNullSafe(F.col("start"))).cast("int")
    runs = once.withColumn("opens", 1 - opens).withColumn("run", F.sum("opens").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min_by("pre", "start").alias("pre"), F.min_by("first_pre", "start").alias("first_pre"), F.max_by("post", "start").alias("post"), F.max_by("first_post", "start").alias("first_post")]
    runs = runs.groupBy("k", "r", "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.min("first_k").alias("first_k"), *ends)
    runs = runs.where(F.col("size") + 2 * CONTEXT >= least_bytes).select("k", "start", "size", "first_k", "r", "pre", "first_pre", "post", "first_post")

    def lengthen(batch: pa.RecordBatch) -> pa.RecordBatch:
        pre, first_pre, post, first_post = (batch.column(i).to_pylist() for i in range(5, 9))
        left = np.array(list(map(_shared_end, pre, first_pre)), dtype=np.int64)
        right = np.array(list(map(_shared, post, first_post)), dtype=np.int64)
        start, size = batch.column(1).to_numpy() - left, batch.column(2).to_numpy() + left + right
        cols = [batch.column(0), pa.array(start), pa.array(size), batch.column(3), batch.column(4)]
        return pa.RecordBatch.from_arrays(cols, names=["k", "start", "size", "first_k", "r"])

    kind = runs.schema["k"].dataType.simpleString()
    return map_batches(runs, lengthen, f"k {kind}, start long, size long, first_k {kind}, r long").where(F.col("size") >= least_bytes)


def remove(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the passages of ``repeated_passages`` cut from its texts; all rows and columns stay.

    Rows that repeat both key and text lose the same passages; the first occurrence of each stays in some text.
    """
    spans = passages.groupBy("k", "r").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(*[named(c).alias(new) for c, new in names.items()], F.xxhash64(named(text).cast("string")).alias("t"))
    frame = frame.join(spans, (F.col("t") == F.col("r")) & F.col(names[key]).eqNullSafe(F.col("k")), "left").select(*names.values(), "spans")
    at, columns = docs.columns.index(text), docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        for i, spans in enumerate(batch.column(len(columns)).to_pylist()):
            if spans and texts[i]:
                data, begin, left = texts[i].encode("utf-8", "surrogatepass"), 0, []
                for s in sorted(spans, key=lambda x: x["start"]):
                    left.append(data[begin : s["start"]])
                    begin = max(begin, s["start"] + s["size"])
                texts[i] = b"".join([*left, data[begin:]]).decode("utf-8", "surrogatepass")
        cols = batch.columns[:-1]
        cols[at] = pa.array(texts, cols[at].type)
        return pa.RecordBatch.from_arrays(cols, names=columns)

    return map_batches(frame, cut, docs.schema)
