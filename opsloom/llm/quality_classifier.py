"""Quality classifier: random-indexing word vectors, pooled by text, then a two-layer network with calibrated scores.

Random indexing gives each word (its hash bucket) and each word shape a sparse random index vector; a word's vector is
the sum of the index vectors around it over the sample, plus its own. A text is the mean vector of its words and that
of its shapes. The network is trained in numpy on a bounded sample of labelled texts, and one temperature, fitted on
texts that it was not trained on, calibrates its probabilities. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import map_batches, prepare, saved

#: Labelled texts that the model is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Buckets of words and of shapes, length of vectors, non-zeros of an index vector, words on either side that count.
WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 15, 1 << 10, 64, 4, 2
#: Hidden units, passes over the sample, texts a step, learning rate, weight decay.
HIDDEN, EPOCHS, STEP, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
#: Tasks that the sample is dealt to, rows of vectors summed at once, words remembered in a worker.
TASKS, SLAB, REMEMBERED = 16, 1 << 11, 400_000
#: Scores of this or more predict label 1.
THRESHOLD = 0.3
_CLASSES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Tokens(dict):
    """Word -> its word bucket, and its shape's bucket above that."""

    def __missing__(self, word: bytes) -> int:
        shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))[:12]
        t = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % WORDS | (xxhash.xxh3_64_intdigest(shape) % SHAPES) << 16
        return t


_tokens = _Tokens()


def _forget() -> None:
    _tokens.clear()


_AGAIN = WORDS + SHAPES  # the vector of a word that repeats the one before it


def _read(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word rows and shape rows (of the vectors) of a text; a word that repeats the last one counts as such."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if len(_tokens) > REMEMBERED:
        _tokens.clear()
    both = np.fromiter(map(_tokens.__getitem__, words), dtype=np.int64, count=len(words))
    word, shape = both & 0xFFFF, (both >> 16) + WORDS
    word[1:][both[1:] == both[:-1]] = _AGAIN
    return word, shape


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of every index vector."""
    g = np.random.Generator(np.random.PCG64(11))
    rows = WORDS + SHAPES + 1
    return np.argsort(g.random((rows, DIM)), axis=1)[:, :NONZERO].astype(np.int64), g.integers(0, 2, (rows, NONZERO)) * 2 - 1


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors around each word, over a task's texts, in slabs of rows."""
    places, signs = _index_vectors()
    rows = WORDS + SHAPES + 1
    total = np.zeros(rows * DIM, dtype=np.float64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            word, shape = _read(text)
            for reach in range(1, REACH + 1):
                for here, near in ((word[reach:], word[:-reach]), (word[:-reach], word[reach:])):
                    for s in range(NONZERO):
                        np.add.at(total, here * DIM + places[near, s], signs[near, s])
            for s in range(NONZERO):
                np.add.at(total, shape * DIM + places[word, s], signs[word, s])
    total = total.reshape(rows, DIM).astype(np.int32)
    slabs = range(0, rows, SLAB)
    yield pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int32()), pa.array([total[a : a + SLAB].tobytes() for a in slabs], pa.binary())], names=["slab", "sums"])


def _add_slabs(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in rows["sums"])
    return pd.DataFrame({"slab": [rows["slab"].iloc[0]], "sums": [total.astype(np.int64).tobytes()]})


def _word_vectors(texts: DataFrame) -> np.ndarray:
    """The vectors (float32, rows of fixed number): 9 MB whatever the input, so they may be sent about."""
    parts = texts.repartition(TASKS).mapInArrow(_contexts, "slab int, sums binary").groupBy("slab").applyInPandas(_add_slabs, "slab int, sums binary").collect()
    sums = np.concatenate([np.frombuffer(r["sums"], dtype=np.int64) for r in sorted(parts, key=lambda r: r["slab"])] or [np.zeros(0)])
    rows = WORDS + SHAPES + 1
    out = sums.reshape(rows, DIM).astype(np.float64) if sums.size else np.zeros((rows, DIM))
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    places, signs = _index_vectors()
    own = np.zeros((rows, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    return (out + own).astype(np.float32)


def _pool(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """A row for each text: its words' mean vector, its shapes' mean vector, log length."""
    out = np.zeros((len(texts), 2 * DIM + 1), dtype=np.float32)
    rows, sizes, at = [], [], 0

    def flush(first: int) -> None:
        if sum(sizes):
            starts = np.cumsum([0, *sizes[:-1]])
            full = np.flatnonzero(sizes)
            for part in (0, 1):
                sums = np.add.reduceat(vectors[np.concatenate([r[part] for r in rows])], starts[full], axis=0)
                out[first + full, part * DIM : (part + 1) * DIM] = sums / np.array(sizes)[full, None]
        rows.clear()
        sizes.clear()

    for i, text in enumerate(texts):
        rows.append(_read(text))
        sizes.append(len(rows[-1][0]))
        out[i, -1] = np.log1p(sizes[-1]) / 5
        if sum(sizes) > 100_000:
            flush(at)
            at = i + 1
    flush(at)
    return out


class Network:
    """Two layers: tanh, then a logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        g = np.random.Generator(np.random.PCG64(3))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1))
        self.temperature = 1.0
        p = [g.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.p = p
        if len(y) < 10 or y.min() == y.max():  # nothing to tell apart: the labels' share, or one half
            share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
            self.p = [0 * p[0], p[1], 0 * p[2], np.array([np.log(share / (1 - share))])]
            return
        x = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 0
        tx, ty = x[~held], y[~held]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(EPOCHS):
            order = g.permutation(len(ty))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), STEP):
                bx, by = tx[order[at : at + STEP]], ty[order[at : at + STEP]]
                h = np.tanh(bx @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(by)
                back = np.outer(e, p[2]) * (1 - h * h)
                t += 1
                for i, grad in enumerate((bx.T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        logits, truth = self.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)
        loss = [(np.logaddexp(0, logits / c) - truth * logits / c).mean() for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; a null key is one."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def _sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Ids and labels to learn from, ``most`` at most; ids labelled both ways and null ones are left out."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    one = one.groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z")
    return one.select("__id", F.col("__y").cast("int")).orderBy(F.xxhash64("__id"), "__id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and the network, from ``most`` labelled texts at most, none of them held out."""
    prepare(docs.sparkSession)
    ids = saved(_sample(labels, key, label, most))
    own = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__t"))
    taken = saved(own.join(F.broadcast(ids), "__id").select("__id", "__t", "__y"))  # the bound on ids is ``most``
    vectors = _word_vectors(taken.select("__t"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _pool(sent.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    id_type = taken.schema["__id"].dataType.simpleString()
    pooled = map_batches(taken, pool, f"id {id_type}, y int, x binary", after=_forget).collect()  # ``most`` rows of 516 bytes
    pooled.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["x"]))
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in pooled], dtype=np.float64).reshape(-1, 2 * DIM + 1)
    return vectors, Network(x, np.array([r["y"] for r in pooled], dtype=np.float64))


def apply(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, score, predicted).

    ``score`` is the probability of label 1; null and empty texts are texts without words and have one too. Labels
    other than 0 and 1, null ids and ids with both labels teach nothing; without two kinds of labels every score is
    the labels' share (one half without any). Rows with a null id count as held out.
    """
    vectors, network = fit(docs, labels, key, text, label, most)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, net = sent.value
        s = net.score(_pool(own, batch.column(2).to_pylist()).astype(np.float64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("t"))
    return map_batches(rows, score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int", after=_forget)
