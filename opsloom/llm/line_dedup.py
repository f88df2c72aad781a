"""Line dedup: content-defined chunks of lines; multi-line chunks that occur again anywhere are removed.

A rolling hash over the hashes of the last ``WINDOW`` lines decides where a chunk ends, so inserted or removed lines
move the boundaries near them only. Chunks of two lines or more are grouped over the whole corpus by digest and by
their bytes: two chunks are equal only when their bytes are. The first occurrence (least id, then position) stays.

Chunks alone miss passages whose boundaries fall on foreign lines. With ``extend`` every two neighbouring lines are
compared as well, so each line of a run of two lines or more that occurred before goes, wherever boundaries are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import bitmap, hot_join, in_bitmap, map_batches, named, prepare, row_id, saved

#: Lines that the rolling hash looks at, and the mean number of lines in a chunk.
WINDOW, MEAN_LINES = 2, 3
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def chunk_bounds(lines: list[bytes]) -> list[int]:
    """Where chunks of ``lines`` end (exclusive, the last is ``len(lines)``); depends on the lines' content only."""
    if not lines:
        return []
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), dtype=np.uint64, count=len(lines))
    rolled = h * _FACTORS[0]
    for k in range(1, WINDOW):
        rolled[k:] += h[:-k] * _FACTORS[k]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _FACTORS[1]
    ends = (np.flatnonzero((rolled >> np.uint64(33)) % np.uint64(MEAN_LINES) == 0) + 1).tolist()
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def units(lines: list[bytes], extend: bool) -> list[tuple[int, int]]:
    """What is compared of a text, as number of the first line and of lines: multi-line chunks, or pairs of neighbouring lines.

    Units of blank lines alone are none. With ``extend`` chunks that hold two blank lines in a row are units too, as
    pairs do not make them up.
    """
    full = [bool(x.strip()) for x in lines]
    out = [(i, 2) for i in range(len(lines) - 1) if full[i] or full[i + 1]] if extend else []
    at = 0
    for end in chunk_bounds(lines):
        if end - at > 1 and any(full[at:end]) and not (extend and all(full[i] or full[i + 1] for i in range(at, end - 1))):
            out.append((at, end - at))
        at = end
    return out


def _unit_rows(docs: DataFrame, key: str, text: str, extend: bool, only: np.ndarray | None, digest_bytes: int) -> DataFrame:
    """Rows (k, r, v, line, size, digest, body) of the units whose hash may be in the bitmap ``only``; without it (h) alone."""
    t = named(text).cast("string")
    r, v = row_id(named(key), t)
    frame = docs.select(named(key).alias("k"), t.alias("t"), r.alias("r"), v.alias("v")) if only is not None else docs.select(t.alias("t"))
    at = frame.columns.index("t")
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bodies, places, owner = [], [], []
        for i, t in enumerate(batch.column(at).to_pylist()):
            lines = t.encode("utf-8", "surrogatepass").split(b"\n") if t else []
            found = units(lines, extend)
            bodies += [b"\n".join(lines[a : a + n]) for a, n in found]
            places += found
            owner += [i] * len(found)
        if not bodies:
            return None
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, bodies), dtype=np.uint64, count=len(bodies)).view(np.int64)
        if sent is None:
            return pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
        take = np.flatnonzero(in_bitmap(sent.value, h)).tolist()
        if not take:
            return None
        rows = pa.array([owner[i] for i in take])
        cols = [batch.column(0).take(rows), batch.column(2).take(rows), batch.column(3).take(rows)]
        cols += [pa.array([places[i][j] for i in take], pa.int32()) for j in (0, 1)]
        cols += [pa.array([hashlib.blake2b(bodies[i], digest_size=digest_bytes).digest() for i in take], pa.binary()), pa.array([bodies[i] for i in take], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["k", "r", "v", "line", "size", "digest", "body"])

    kind = docs.select(named(key)).schema[0].dataType.simpleString()
    return map_batches(frame, cut, "h long" if only is None else f"k {kind}, r long, v long, line int, size int, digest binary, body binary")


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", extend: bool = False, digest_bytes: int = 16) -> DataFrame:
    """Units to remove: rows (r, v, line, size), the id of key and text, the number of the unit's first line and of its lines.

    Of equal units the one with the least (key, line) stays; null keys come last. Rows that repeat both key and text
    count as one here and are told apart in ``apply``. Units are equal where their bytes are, whatever their digests.
    """
    again = _unit_rows(docs, key, text, extend, None, digest_bytes).groupBy("h").count().where("count > 1").select("h")
    found = saved(_unit_rows(docs, key, text, extend, bitmap(again), digest_bytes))
    # Equal bytes: the group's key has them; counts and minima are combined before the shuffle, so a hot unit is one row a task.
    place = F.struct(F.col("k").isNull().alias("none"), "k", "line", "r", "v")
    groups = found.groupBy("digest", "body").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # A digest with one body stands for it from here on.
    first = saved(groups.groupBy("digest").agg(F.count("*").alias("bodies"), F.sum("n").alias("n"), F.min("first").alias("first")))
    places = found.select("r", "v", "line", "size", "digest")
    seen = hot_join(places, first.where("bodies = 1 and n > 1").select("digest", "first", "n"), "digest", "n")
    clashes = first.where("bodies > 1").select("digest")
    if clashes.limit(1).count():  # bodies that share a digest are joined by their bytes
        own = groups.where("n > 1").join(clashes, "digest", "left_semi").select("digest", "body", "first")
        seen = seen.unionByName(found.join(own, ["digest", "body"]).select(*places.columns, "first"))
    return seen.where("not (r = first.r and v = first.v and line = first.line)").select("r", "v", "line", "size")


def _dropped(lines: list[bytes], drop: set[tuple[int, int]] | None, extend: bool) -> list[bool]:
    """Which lines go with the units in ``drop`` (first line, lines), or with all units where it is None."""
    gone = [False] * len(lines)
    firsts = {a for a, _ in drop or ()}
    for a, n in units(lines, extend):
        if drop is None or (a, n) in drop:
            # A line repeated three times: the second pair shares a line with the first, which stays.
            kept = drop is not None and n == 2 and a > 0 and a - 1 not in firsts and lines[a - 1] == lines[a] == lines[a + 1] and extend
            gone[a + kept : a + n] = [True] * (n - kept)
    return gone


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text", extend: bool = False, digest_bytes: int = 16) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and ``n_removed_lines`` and ``n_removed_chunks``.

    With ``extend`` every line goes that lies in a run of two lines or more that occurred before, and
    ``n_removed_chunks`` counts the runs removed. All rows and columns stay (columns of these two names, in whatever
    case, are replaced). A null text stays null and loses nothing; a text that loses every line becomes empty. A text
    left as it was is returned byte for byte. Rows that share a key but not the text are told apart. Of rows that
    repeat both key and text one counts as the first; the others lose all units.
    """
    prepare(docs.sparkSession)
    gone = repeated_chunks(docs, key, text, extend, digest_bytes).groupBy("r", "v").agg(F.collect_set(F.struct("line", "size")).alias("drop"))
    keep = [c for c in docs.columns if c.lower() not in ("n_removed_lines", "n_removed_chunks")]
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    r, v = row_id(named(key), named(text).cast("string"))
    frame = docs.select(*[named(c).alias(new) for c, new in names.items()], r.alias("r"), v.alias("v"))
    # The join has dealt the rows out by these two already.
    joined = frame.join(gone, ["r", "v"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("r", "v").orderBy("r"))).select(*names.values(), "drop", "nth")
    schema = docs.select(*[named(c) for c in keep]).schema.add("n_removed_lines", "long").add("n_removed_chunks", "long")
    at = keep.index(text)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines_out, chunks_out = batch.column(at).to_pylist(), [], []
        nth = batch.column(len(keep) + 1).to_pylist()
        for i, found in enumerate(batch.column(len(keep)).to_pylist()):
            n = runs = 0
            if texts[i] and (found or nth[i] > 1):
                lines = texts[i].encode("utf-8", "surrogatepass").split(b"\n")
                lost = _dropped(lines, {(x["line"], x["size"]) for x in found or ()} if nth[i] == 1 else None, extend)
                n = sum(lost)
                if n:
                    ends = {a + size for a, size in units(lines, False)} if not extend else set()
                    runs = sum(x and (j == 0 or not lost[j - 1] or j in ends) for j, x in enumerate(lost))
                    texts[i] = b"\n".join(x for x, y in zip(lines, lost) if not y).decode("utf-8", "surrogatepass")
            lines_out.append(n)
            chunks_out.append(runs)
        cols = batch.columns[: len(keep)]
        cols[at] = pa.array(texts, batch.column(at).type)
        return pa.RecordBatch.from_arrays([*cols, pa.array(lines_out, pa.int64()), pa.array(chunks_out, pa.int64())], names=[*keep, "n_removed_lines", "n_removed_chunks"])

    return map_batches(joined, cut, schema)
