"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, with DivideSkip.

Two texts link when their sets of 5-word shingles have a Jaccard index of 0.8 or more. The search is exact:

1. Texts with equal sets are one node from here on (their digest is its key).
2. Of each set a prefix of the smallest shingle hashes goes through one count of its shingles. Linked sets share at
   least ``need`` shingles of their prefixes, so a set with fewer shared ones is left out: most texts end here.
3. The rest are ordered by rarity of their shingles. Linked sets share one of the ``n - ceil(0.8 n) + 1`` rarest, so
   sets fall into groups that share none of these.
4. Groups, packed to units of bounded size, are searched by T-occurrence: the longest lists are set aside, the short
   ones are merged, and what occurs often enough there is looked up in the long ones. A large group is searched as
   pairs of its blocks. Of links within what is connected already only one path is told, never all pairs.
5. Components of the links give the result.

Hot shingles and groups of copies cost a row for each text that holds them, and a block pair's work at most in a task.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import bitmap, components, discarded, hot_join, in_bitmap, map_batches, named, prepare, saved

WORDS = 5
#: Shingles in a unit of the search: what one task holds at a time.
UNIT = 2_000_000
#: Weight of a lookup against a merge step in the choice of how many lists are set aside.
MU = 0.0085
#: Words remembered in a worker at most; then it begins anew.
REMEMBERED = 400_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _forget() -> None:
    _words.clear()


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes (int64) of a text's distinct shingles: A-Z in lower case; with under WORDS words, all as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(_words) > REMEMBERED:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size) * _MIX[4], dtype=np.uint64)
        for k in range(size):
            out += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _MIX[k]
        out ^= out >> np.uint64(31)
        out *= _MIX[1]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _least(n: int) -> int:
    """The least overlap of a set of n with any set it links to: ceil(0.8 n)."""
    return -(-4 * n // 5)


def _extra(n: int) -> int:
    return 1 + n // 8


def prefix_size(n: int) -> int:
    return min(n, n - _least(n) + _extra(n))


def need(n: int) -> int:
    """Linked sets share at least so many shingles of their prefixes: their common ones come first in order."""
    return min(_extra(n), _extra(_least(n)))


def _sets(docs: DataFrame, key: str, text: str, only: np.ndarray | None) -> DataFrame:
    """Rows (k, n, digest, part, need): part is the prefix, or the whole set of texts whose key may be in ``only``."""
    frame = docs.select(named(key).alias("k"), F.xxhash64(named(key)).alias("kh"), named(text).cast("string").alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if sent is not None:
            batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column(1).to_numpy(zero_copy_only=False))))
            if not batch.num_rows:
                return None
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        parts = sets if sent is not None else [s[: prefix_size(len(s))] for s in sets]
        ends = np.cumsum([0, *map(len, parts)])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, dtype=np.int64)]))),
                pa.array([need(len(s)) for s in sets], pa.int64()),
            ],
            names=["k", "n", "digest", "part", "need"],
        )

    return map_batches(frame, make, f"k {kind}, n long, digest binary, part array<long>, need long", after=_forget)


class _Forest:
    """Which rows are connected; labels are arrays, so that whole lists are compared at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        mx, my = self.members.pop(x, [x]), self.members.pop(y, [y])
        if len(mx) < len(my):
            x, mx, my = y, my, mx
        self.label[my] = x
        self.members[x] = mx + my


def search(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets`` (a forest of them); with ``side``, only links across sides count.

    Each set is looked for among the sets of its size or less; T is the overlap that a link takes.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    if not len(order) or not sizes.sum():
        return []
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    by = np.argsort(flat, kind="stable")
    lists, where, counts = np.unique(flat[by], return_index=True, return_counts=True)
    owners = owner[by]
    of = np.empty(len(flat), dtype=np.int64)  # the list of each set's shingles
    of[by] = np.repeat(np.arange(len(lists)), counts)
    ends = np.r_[0, np.cumsum(sizes)]
    sides = None if side is None else np.asarray(side)[order]
    forest, found = _Forest(len(order)), []
    longest = max(2, int(counts.max()))
    for x in range(1, len(order)):
        nx = int(sizes[x])
        if not nx:
            continue
        least = _least(nx)
        mine = of[ends[x] : ends[x + 1]]
        mine = mine[np.argsort(counts[mine], kind="stable")]
        aside = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        short, long = mine[: nx - aside], mine[nx - aside :]
        short = short[counts[short] > 1]
        if not len(short):
            continue
        low = int(np.searchsorted(sizes, least))
        slices = [owners[where[j] : where[j] + counts[j]] for j in short.tolist()]
        if sum(map(len, slices)) < 200:
            merged = np.fromiter(heapq.merge(*[s.tolist() for s in slices]), dtype=np.int32)
        else:  # the same merge for lists too long for a heap of Python numbers
            merged = np.sort(np.concatenate(slices), kind="stable")
        cand, n = np.unique(merged, return_counts=True)
        wanted = -(-4 * (nx + sizes[cand]) // 9)  # 0.8 of the union
        ok = (cand < x) & (cand >= low) & (n + len(long) >= wanted) & (forest.label[cand] != forest.label[x])
        if sides is not None:
            ok &= sides[cand] != sides[x]
        cand, n, wanted = cand[ok], n[ok], wanted[ok]
        for done, j in enumerate(long.tolist()):
            if not len(cand):
                break
            listed = owners[where[j] : where[j] + counts[j]]
            at = np.minimum(np.searchsorted(listed, cand), len(listed) - 1)
            n = n + (listed[at] == cand)
            keep = n + (len(long) - done - 1) >= wanted
            if not keep.all():
                cand, n, wanted = cand[keep], n[keep], wanted[keep]
        for y in cand.tolist():
            if forest.label[y] != forest.label[x]:
                forest.join(x, y)
                found.append((order[x], order[y]))
    return found


def _units(sets: DataFrame) -> DataFrame:
    """Rows of ``sets`` (digest, n, tokens, blob) with the unit (u, i, j) that searches them, and their side there."""
    sized = sets.groupBy("blob").agg(F.sum("n").alias("weight"))
    total = sized.where(F.col("weight") <= UNIT).agg(F.sum("weight")).first()[0] or 0
    packs = max(1, math.ceil(2 * total / UNIT))
    rows = sets.join(sized, "blob")
    small = rows.where(F.col("weight") <= UNIT).select("digest", "tokens", F.pmod(F.xxhash64("blob"), F.lit(packs)).alias("u"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    blocks = F.ceil(F.col("weight") / (UNIT // 2)).cast("int")
    large = rows.where(F.col("weight") > UNIT).withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    large = large.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("digest", "tokens", F.col("blob").alias("u"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.col("b").alias("side"))
    return small.union(large)


def _search_unit(rows: pd.DataFrame) -> pd.DataFrame:
    across = rows["i"].iloc[0] != rows["j"].iloc[0]
    digests = rows["digest"].tolist()
    found = search([np.asarray(t) for t in rows["tokens"]], rows["side"].to_numpy() if across else None)
    return pd.DataFrame({"a": [digests[x] for x, _ in found], "b": [digests[y] for _, y in found]})


def _shared_entries(sets: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows (keep, s, df) of the shingles in ``column`` that more than one row of ``sets`` holds, and how many do.

    Counts are combined before they are shuffled. Single shingles, nearly all of them in most corpora, are left out
    by a bitmap before the counts are joined to the rest; a hot shingle's rows stay where they are.
    """
    counts = saved(sets.select(F.explode(column).alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1").withColumn("n", F.col("df")))
    sent = sets.sparkSession.sparkContext.broadcast(bitmap(counts.select("s")))
    frame = sets.select(*keep, F.col(column).alias("s"))

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(len(keep))
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        ok = in_bitmap(sent.value, np.ascontiguousarray(flat)) if len(flat) else np.zeros(0, dtype=bool)
        taken = np.r_[0, np.cumsum(ok)][ends]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(taken, pa.int32()), pa.array(flat[ok]))], names=[*keep, "s"])

    entries = map_batches(frame, narrow, frame.schema.simpleString()[len("struct<") : -1].replace(":", " ")).select(*keep, F.explode("s").alias("s"))
    return hot_join(entries, counts, "s", "n")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts (k, n, digest) and links (a, b) between digests that connect all that is linked."""
    prepare(docs.sparkSession)
    rows = saved(_sets(docs, key, text, None))
    texts = rows.select("k", "n", "digest")
    # 2. sets with too few shared shingles in their prefixes
    node = F.xxhash64("digest").alias("node")
    once = saved(rows.where("n > 0").groupBy("digest").agg(F.min("k").alias("k"), F.first("need").alias("need"), F.first("part").alias("part")).withColumn("node", node))
    shared = _shared_entries(once, "part", ["node"]).groupBy("node").agg(F.count("*").alias("m"))
    left = saved(once.select("digest", "k", "need", "node").join(shared, "node").where("m >= need").select("digest", "k"))
    discarded(once)
    # 3. whole sets of what is left, by rarity
    only = bitmap(left.select(F.xxhash64("k").alias("h")))
    again = _sets(docs, key, text, only).join(left.select(F.col("digest").alias("d"), F.col("k").alias("lk")), (F.col("digest") == F.col("d")) & F.col("k").eqNullSafe(F.col("lk")))
    sets = saved(again.select("digest", node, "n", F.col("part").alias("tokens")).dropDuplicates(["digest"]))
    rare = _shared_entries(sets, "tokens", ["node", "n"]).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by"))
    spare = F.expr("n - ceil(n * 4 / 5) + 1 - (n - size(by))").cast("int")  # shared shingles in the prefix of the rarest
    prefix = saved(rare.withColumn("spare", spare).where("spare > 0").select("node", F.explode(F.slice("by", F.lit(1), F.col("spare"))).alias("e")).select("node", F.col("e.s").alias("s")))
    tops = saved(prefix.groupBy("s").agg(F.min("node").alias("top"), F.count("*").alias("n")).where("n > 1"))
    star = hot_join(prefix, tops, "s", "n").select(F.col("node").alias("a"), F.col("top").alias("b")).distinct()
    blobs = components(star)
    # 4. the search itself
    grouped = _units(sets.join(blobs.withColumnRenamed("component", "blob"), "node"))
    found = saved(grouped.groupBy("u", "i", "j").applyInPandas(_search_unit, "a binary, b binary"))
    discarded(left, sets, prefix, tops)
    return texts, found


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: (doc_id, n_shingles, component_id), the least key that its links reach, itself included.

    Null and empty texts, and texts without a word, have 0 shingles and reach themselves only. Texts with equal sets
    are linked. A null key counts for nothing as the least key: a row has a null component only if it reaches no key.
    """
    texts, found = links(docs, key, text)
    parts = components(found)
    nodes = texts.where("digest is not null").groupBy("digest").agg(F.min("k").alias("k"))
    inside = nodes.join(parts, nodes["digest"] == parts["node"]).select("digest", "k", "component")
    least = inside.groupBy("component").agg(F.min("k").alias("component_id"))
    linked = inside.join(least, "component").select("digest", "component_id")
    alone = nodes.join(parts, nodes["digest"] == parts["node"], "left_anti").select("digest", F.col("k").alias("component_id"))
    told = linked.union(alone).withColumnRenamed("digest", "d")
    out = texts.join(told, texts["digest"] == told["d"], "left")
    # Empty sets have no digest, and so no component but their own key.
    return out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the least key.

    Rows that share a key are one document, of which the least text stays. Rows with a null key cannot be told apart
    and all stay.
    """
    told = apply(docs, key, text)
    kept = told.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(*[named(c).alias(new) for c, new in names.items()])
    k, t = names[key], names[text]
    rows = frame.join(kept, F.col(k) == F.col("kept"), "left_semi")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(k).orderBy(t))).where("nth = 1").drop("nth")
    return rows.unionByName(frame.where(F.col(k).isNull())).select(*[F.col(new).alias(c) for c, new in names.items()])
