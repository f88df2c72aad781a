"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one a shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id. A shard's equal vectors become one node.
Its graph grows by batches: a greedy beam search from the entry point proposes neighbours for each new node, and robust
pruning keeps those that no kept neighbour covers (by ``ALPHA`` times the distance), with edges in both directions. A
query walks every shard's graph with a beam; what the shards find is scored on the original vectors in double
precision and merged. Queries come in blocks of bounded size, so a task holds one shard and one block.

Inner products become distances by one more coordinate that brings all vectors of a shard to one length; queries have 0
there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import prepare, saved

#: Vectors in a shard, queries in a block.
SHARD, BLOCK = 4096, 4096
#: Edges of a node, beam while building, beam of a query, slack of pruning, nodes added at once.
DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA, BATCH = 32, 32, 96, 1.2, 512


def _distances(points: np.ndarray, norms: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances, less each query's own square, of queries ``to`` (q, d) to points ``rows`` (q, m)."""
    return norms[rows] - 2.0 * np.einsum("qmd,qd->qm", points[rows], to)


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met by a greedy walk, for all queries at once: (ids, distances), nearest first; -1 fills up."""
    q, n = len(to), len(points)
    ids = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    ids[:, 0] = entry
    dist[:, 0] = _distances(points, norms, ids[:, :1], to)[:, 0]
    done[:, 0] = False
    seen = np.zeros((q, (n + 7) // 8), dtype=np.uint8)
    seen[:, entry >> 3] |= np.uint8(1 << (entry & 7))
    live = np.arange(q)
    while len(live):
        first = (~done[live]).argmax(1)
        open_ = ~done[live, first]
        live, first = live[open_], first[open_]
        if not len(live):
            break
        done[live, first] = True
        near = edges[ids[live, first]]
        got = np.maximum(near, 0)
        new = (near >= 0) & ((seen[live[:, None], got >> 3] >> (got & 7).astype(np.uint8)) & 1 == 0)
        for k in range(near.shape[1]):  # edges of a node are distinct, but two may share a byte
            r = new[:, k]
            seen[live[r], got[r, k] >> 3] |= (1 << (got[r, k] & 7)).astype(np.uint8)
        d = np.where(new, _distances(points, norms, got, to[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(new, got, -1)], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), axis=1, kind="stable"), 1)
        ids[live] = np.take_along_axis(all_i, keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1) | (ids[live] < 0)
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, dist: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Edges of nodes ``own``: of candidates (q, m; -1 none, true squared distances ``dist``), nearest first, each is kept
    unless a kept one is ``alpha`` times nearer to it than the node is. All nodes are pruned at once.
    """
    q, m = cand.shape
    dist = np.where((cand < 0) | (cand == own[:, None]), np.inf, dist)
    order = np.argsort(cand, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    dist[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf  # the same node twice
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    at = points[np.maximum(cand, 0)]
    sq = np.einsum("qmd,qmd->qm", at, at)
    out = np.full((q, degree), -1, dtype=np.int32)
    count = np.zeros(q, dtype=np.int64)
    alive = np.isfinite(dist)
    for _ in range(degree):
        pick = alive.argmax(1)
        ok = alive[np.arange(q), pick]
        if not ok.any():
            break
        r = np.flatnonzero(ok)
        p = pick[r]
        out[r, count[r]] = cand[r, p]
        count[r] += 1
        alive[r, p] = False
        between = sq[r] + sq[r, p][:, None] - 2.0 * np.einsum("qmd,qd->qm", at[r], at[r, p])
        alive[r] &= alpha * alpha * np.maximum(between, 0) > dist[r]
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Edges (n, degree; -1 none) and the entry point of the graph of ``points`` (distinct rows)."""
    n = len(points)
    norms = np.einsum("nd,nd->n", points, points)
    entry = int(np.argmin(norms - 2.0 * points @ points.mean(0))) if n else 0
    edges = np.full((n, degree), -1, dtype=np.int32)
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = np.r_[entry, order[order != entry]] if n else order
    at = 1
    while at < n:
        new = order[at : at + max(1, min(batch, at))]
        at += len(new)
        ids, d = beam_search(points, norms, edges, entry, points[new], beam)
        near = new if len(new) <= beam else None
        true = d + norms[new][:, None]
        if near is not None and len(new) > 1:  # a small batch also looks at itself
            mutual = np.broadcast_to(new, (len(new), len(new)))
            ids = np.concatenate([ids, mutual], 1)
            true = np.concatenate([true, norms[mutual] + norms[new][:, None] - 2.0 * points[new] @ points[new].T], 1)
        chosen = robust_prune(points, new, ids, true, alpha, degree)
        edges[new] = chosen
        # edges back; where a node has no room, it is pruned anew
        r, c = np.nonzero(chosen >= 0)
        back, source = chosen[r, c], new[r]
        by = np.argsort(back, kind="stable")
        back, source = back[by], source[by]
        heads, starts, counts = np.unique(back, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        for part in range(0, len(heads), 2048):
            h, s, k = heads[part : part + 2048], starts[part : part + 2048], counts[part : part + 2048]
            wide = np.full((len(h), degree + width), -1, dtype=np.int64)
            wide[:, :degree] = edges[h]
            cols = np.arange(width)[None, :]
            fill = cols < k[:, None]
            wide[:, degree:][fill] = source[(s[:, None] + cols)[fill]]
            wide.sort(axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1  # two new nodes may have chosen each other
            room = ((wide >= 0).sum(1) <= degree)
            if room.any():
                packed = np.take_along_axis(wide[room], np.argsort(wide[room] < 0, axis=1, kind="stable"), 1)
                edges[h[room]] = packed[:, :degree]
            if (~room).any():
                w, own = wide[~room], h[~room]
                w = np.take_along_axis(w, np.argsort(w < 0, axis=1, kind="stable"), 1)[:, : int((w >= 0).sum(1).max())]
                true = _distances(points, norms, np.maximum(w, 0), points[own]) + norms[own][:, None]
                edges[own] = robust_prune(points, own, w, true, alpha, degree)
    return edges, entry


def _lifted(vectors: np.ndarray) -> np.ndarray:
    norms = np.einsum("nd,nd->n", vectors, vectors)
    rest = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, each summed in the same order."""
    return (a * b).sum(1)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's index as a row: distinct vectors, the ids of each (as many as a result can hold), edges, entry."""
    vectors = np.array(rows["v"].tolist(), dtype=np.float64)
    ids = rows["id"].to_numpy(dtype=np.int64)
    by = np.argsort(ids, kind="stable")
    vectors, ids = vectors[by], ids[by]
    nodes, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    by = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by], np.arange(len(nodes)))
    most = int(rows["most"].iloc[0])
    nth = np.arange(len(of)) - starts[of[by]]
    by = by[nth < most]  # beyond so many ids of one vector none can be in a result: they tie, and the least ids win
    edges, entry = build(_lifted(nodes))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "dim": [rows["dim"].iloc[0]], "nodes": [nodes.tobytes()], "node_of": [of[by].astype(np.int32).tobytes()], "ids": [ids[by].tobytes()], "edges": [edges.tobytes()], "entry": [entry]})


def _answers(k: int, beam: int):
    def run(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = index.iloc[0]
        nodes = np.frombuffer(row["nodes"]).reshape(-1, int(row["dim"]))
        node_of, ids = np.frombuffer(row["node_of"], dtype=np.int32), np.frombuffer(row["ids"], dtype=np.int64)
        starts = np.searchsorted(node_of, np.arange(len(nodes) + 1))
        edges = np.frombuffer(row["edges"], dtype=np.int32).reshape(len(nodes), -1)
        points = _lifted(nodes)
        norms = np.einsum("nd,nd->n", points, points)
        vectors, own = np.array(queries["v"].tolist(), dtype=np.float64), queries["id"].to_numpy(dtype=np.int64)
        out = []
        for at in range(0, len(own), 512):
            to = vectors[at : at + 512]
            found, _ = beam_search(points, norms, edges, int(row["entry"]), np.concatenate([to, np.zeros((len(to), 1))], 1).astype(np.float32), max(beam, k + 1))
            q, c = np.nonzero(found >= 0)
            node = found[q, c]
            size = starts[node + 1] - starts[node]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit = pd.DataFrame({"q": np.repeat(q, size), "vec_id": ids[np.repeat(starts[node], size) + offset], "score": np.repeat(_score(nodes[node], to[q]), size)})
            hit = hit[hit["vec_id"].to_numpy() != own[at : at + 512][hit["q"].to_numpy()]]
            hit = hit.sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
            hit = hit[hit.groupby("q").cumcount() < k]
            out.append(pd.DataFrame({"query_id": own[at : at + 512][hit["q"].to_numpy()], "vec_id": hit["vec_id"].to_numpy(), "score": hit["score"].to_numpy()}))
        return pd.concat(out)

    return run


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, with finite components only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard: int = SHARD, beam: int = QUERY_BEAM) -> DataFrame:
    """The k nearest found of each query: (query_id, rank, vec_id, score), by the largest inner product.

    Ties go to the smaller id. A query is not its own neighbour: rows with its id are left out. Vectors of another
    length than the query's have no inner product with it and are not found. Null, zero and non-finite vectors, and
    rows without an id, take no part; repeated ids with different vectors are rows of their own, and all are told.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(q / BLOCK))
    dim = F.size("v").alias("dim")
    dealt = rows.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(k + 1).alias("most"))
    index = dealt.repartition(min(shards, 10_000), "dim", "shard").groupBy("dim", "shard").applyInPandas(_index, "shard int, dim int, nodes binary, node_of binary, ids binary, edges binary, entry long")
    index = saved(index)
    each = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = asked.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    own = own.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["dim", "shard", "block"]
    parts = min(shards * blocks, 10_000)
    found = each.repartition(parts, *by).groupBy(*by).cogroup(own.repartition(parts, *by).groupBy(*by)).applyInPandas(_answers(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
