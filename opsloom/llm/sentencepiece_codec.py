"""SentencePiece encoding and decoding of whole texts, with batched numpy Viterbi.

A text falls into units that no piece can span (it is split before each word's space mark). Units not met before are
grouped by length; all units of a length advance together through the lattice: hashes of their substrings probe the
sorted keys of the pieces, and the best piece that ends at each position is stored as a backpointer.

Unigram models take the maximum of the summed scores. In a byte-pair model scores only rank merges, and the sum of
scores is not what it maximises; there a step of the lattice is open only if its two pieces, merged on their own, stay
two pieces. Exactly one path is open then, and it is the byte-pair segmentation: a merge over a piece's end depends on
the two pieces beside it alone. So both kinds give what the public library gives.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from opsloom.llm.common import map_batches, named, prepare

MARK = "▁"
_BASE = 0x9E3779B97F4A7C15 | 1
#: Units of more characters go through a heap of merges (byte-pair) or a lattice of one row (unigram).
LONG_UNIT = 64
#: Units and pairs of pieces remembered in a worker at most, over all its tasks; then only those of the texts at hand stay.
REMEMBERED, PAIRS = 400_000, 300_000
_SLOT_BITS = 20
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Fields of a protocol-buffer message: (number, value); lengths give bytes, fixed32 gives a float."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError(f"wire type {kind} in a model file")


class Model:
    """The pieces of a model file. Only models with the identity normaliser are taken."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.bpe, self.dummy, self.byte_fallback = False, True, False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(own.get(2, 0.0))
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                trained = dict(_fields(value))
                self.bpe, self.byte_fallback = trained.get(3, 1) == 2, bool(trained.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps extra white space is supported")
                self.dummy = bool(norm.get(3, 1))
        if _USER in self.kinds:
            raise ValueError("user-defined symbols are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(self.pieces, self.kinds) if k == _NORMAL):
            raise ValueError("a piece spans two words")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())


class Codec:
    """Encodes and decodes in one worker; made from a ``Model`` and remembers units it has met."""

    def __init__(self, model: Model):
        self.m = model
        normal = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == _NORMAL]
        self.ids = dict(normal)
        self.longest = max((len(p) for p, _ in normal), default=1)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(LONG_UNIT + 1, _BASE, dtype=np.uint64)], dtype=np.uint64)
            keys = np.array([self._hash(p) for p, _ in normal], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([i for _, i in normal], dtype=np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array(model.scores, dtype=np.float64)
        self.low = min(model.scores, default=0.0) - 10.0  # what the public library takes for an unknown character
        self.units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # the pairs met last, by a hash of theirs: whole arrays of pairs are looked up at once
        self.slot_keys, self.slot_open = np.full(1 << _SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << _SLOT_BITS, dtype=bool)
        alone = "\n" not in "".join(p for p in self.ids if len(p) > 1)  # then no piece spans it
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.out = [self._bytes_of(i) for i in range(len(model.pieces))]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _bytes_of(self, i: int) -> bytes:
        kind, piece = self.m.kinds[i], self.m.pieces[i]
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(MARK, " ").encode()

    # -- pieces of one string by merging, used for pairs and for long units

    def merge(self, text: str) -> list[str]:
        """Byte-pair segmentation of ``text``: the best-ranked adjacent pair first, the leftmost of equal ones."""
        rank, n = self.m.scores, len(text)
        if n < 2:
            return list(text)
        part, left, right = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b >= 0 and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-rank[i], a, len(part[a]), len(part[b])))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a]
            if len(part[a]) != x or b < 0 or len(part[b]) != y:
                continue  # one of the two has been merged meanwhile
            part[a] += part[b]
            part[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [p for p in part if p]

    # -- the lattice

    def _string(self, i: int) -> str:
        n = len(self.m.pieces)
        return self.m.pieces[i] if i < n else chr(i - n)

    def _open(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether ``piece`` may follow ``before`` (-1 at the start) in a byte-pair segmentation."""
        keys = (before.astype(np.int64) + 1) << 32 | piece
        slots = ((keys.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        ok = self.slot_open[slots]
        missed = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(missed):
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            new, back = np.unique(keys[missed], return_inverse=True)
            found = np.array([self._pair_open(k) for k in new.tolist()], dtype=bool)[back]
            ok[missed] = found
            self.slot_keys[slots[missed]] = keys[missed]
            won = missed[self.slot_keys[slots[missed]] == keys[missed]]  # of several pairs for a slot, one has it now
            self.slot_open[slots[won]] = ok[won]
        return ok

    def _pair_open(self, k: int) -> bool:
        ok = self.pairs.get(k)
        if ok is None:
            a, b = (k >> 32) - 1, self._string(k & 0xFFFFFFFF)
            pair = [b] if a < 0 else [self._string(a), b]
            ok = self.pairs[k] = self.merge("".join(pair)) == pair
        return ok

    def _lattice(self, units: list[str]) -> list[list[int]]:
        """Segmentations of units of one length, as ids; characters without a piece are ``len(pieces) + code point``."""
        n, size = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.int64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, size + 1), dtype=np.uint64)
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * np.uint64(_BASE) + (codes[:, j] + 1).astype(np.uint64)
        total = len(self.m.pieces)
        last = np.full((n, size + 1), -1, dtype=np.int64)
        came = np.zeros((n, size + 1), dtype=np.int16)
        best = np.zeros((n, size + 1))
        rows = np.arange(n)
        for j in range(1, size + 1):
            spans = np.arange(1, min(j, self.longest) + 1)
            with np.errstate(over="ignore"):
                h = prefix[:, j, None] - prefix[:, j - spans] * self.powers[spans][None, :]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            piece = np.where(self.keys[at] == h, self.key_ids[at], -1)
            single = piece[:, 0] < 0
            piece[single, 0] = total + codes[single, j - 1]
            r, c = np.nonzero(piece >= 0)
            found, begin = piece[r, c], j - spans[c]
            gain = np.full(piece.shape, -np.inf)
            if self.m.bpe:
                gain[r, c] = np.where(self._open(last[r, begin], found), 0.0, -np.inf)
            else:
                gain[r, c] = best[r, begin] + np.where(found < total, self.scores[np.minimum(found, total - 1)], self.low)
            top = gain.argmax(1)
            last[:, j], came[:, j], best[:, j] = piece[rows, top], j - spans[top], gain[rows, top]
        out = []
        for path, steps in zip(last.tolist(), came.tolist()):
            ids, j = [], size
            while j:
                ids.append(path[j])
                j = steps[j]
            out.append(ids[::-1])
        return out

    def _final(self, ids: list[int]) -> bytes:
        """Ids as they are told: characters without a piece become their bytes, or else one unknown for each run."""
        total, out = len(self.m.pieces), []
        if max(ids) < total:
            return array("i", ids).tobytes()
        for i in ids:
            if i < total:
                out.append(i)
            elif self.m.byte_fallback:
                out += [self.m.bytes[b] for b in chr(i - total).encode("utf-8", "replace")]
            elif not out or out[-1] != self.m.unknown:
                out.append(self.m.unknown)
        return np.array(out, dtype="<i4").tobytes()

    def learn(self, units: set[str]) -> None:
        """Remember the ids of new units."""
        if len(self.units) > REMEMBERED:
            self.units = {u: self.units[u] for u in units if u in self.units}
        by_size: dict[int, list[str]] = {}
        total = len(self.m.pieces)
        for u in units:
            if u in self.units:
                continue
            if len(u) <= LONG_UNIT:
                by_size.setdefault(len(u), []).append(u)
            elif self.m.bpe:
                self.units[u] = self._final([self.ids.get(p, total + ord(p[0])) for p in self.merge(u)])
            else:
                self.units[u] = self._final(self._walk(u))
        for same in by_size.values():
            for at in range(0, len(same), 4096):
                part = same[at : at + 4096]
                for u, ids in zip(part, self._lattice(part)):
                    self.units[u] = self._final(ids)

    def _walk(self, unit: str) -> list[int]:
        """The best path of one long unit of a unigram model."""
        total, best, came = len(self.m.pieces), [0.0], [(0, 0)]
        for j in range(1, len(unit) + 1):
            top = (-np.inf, 0, 0)
            for i in range(max(0, j - self.longest), j):
                k = self.ids.get(unit[i:j], total + ord(unit[i]) if j - i == 1 else None)
                if k is not None and (x := best[i] + (self.m.scores[k] if k < total else self.low)) > top[0]:
                    top = (x, i, k)
            best.append(top[0])
            came.append(top[1:])
        ids, j = [], len(unit)
        while j:
            j, k = came[j]
            ids.append(k)
        return ids[::-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; none for an empty text, None for null."""
        parts = [None if t is None else self.split((MARK if self.m.dummy else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        out, at = [None] * len(parts), 0
        while at < len(parts):  # so many texts that their units can be remembered together
            new, end = set(), at
            while end < len(parts) and (end == at or len(new) < REMEMBERED // 2):
                new.update(parts[end] or ())
                end += 1
            self.learn(new)
            find = self.units.__getitem__
            for i in range(at, end):
                if parts[i] is not None:
                    out[i] = np.frombuffer(b"".join(map(find, parts[i])), dtype="<i4")
            at = end
        return out

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. Ids outside the model raise."""
        if ids is None:
            return None
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.m.dummy and text.startswith(" ") else text


#: The codec of a worker, by its model's digest: later tasks go on with the units it knows.
_codecs: dict[bytes, Codec] = {}


def _codec(key: bytes, data: Callable[[], bytes]) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Model(data()))
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with column ``ids`` (array<int>, null for a null text); a column of that name, in whatever case, is replaced."""
    return _mapped(docs, model_path, text, f"{ids} array<int>", lambda c, t: [pa.array(c.encode(t), pa.list_(pa.int32()))])


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with column ``text`` decoded from ``ids``; a column of that name is replaced."""
    as_ids = lambda x: None if x is None else np.array(x, dtype=np.int64)
    return _mapped(docs, model_path, ids, f"{text} string", lambda c, t: [pa.array([c.decode(as_ids(x)) for x in t], pa.string())])


def digest(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_pieces``, ``ids_digest`` (SHA-1 of the ids as little-endian int32) and ``round_trip``.

    ``round_trip`` tells whether decoding gives the text back (false where it holds the space mark itself). All three
    are null for a null text.
    """

    def told(c: Codec, texts: list[str | None]) -> list[pa.Array]:
        found = c.encode(texts)
        return [
            pa.array([None if x is None else len(x) for x in found], pa.int64()),
            pa.array([None if x is None else hashlib.sha1(x.tobytes()).hexdigest() for x in found], pa.string()),
            pa.array([None if x is None else c.decode(x) == t for x, t in zip(found, texts)], pa.bool_()),
        ]

    return _mapped(docs, model_path, text, "n_pieces long, ids_digest string, round_trip boolean", told)


def _mapped(docs: DataFrame, model_path: str, column: str, new: str, fn) -> DataFrame:
    prepare(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()
    Model(data)  # what is not supported is told here
    key, sent = hashlib.sha1(data).digest(), docs.sparkSession.sparkContext.broadcast(data)  # half a megabyte
    names = [x.split()[0] for x in new.split(", ")]
    low = {x.lower() for x in names}
    keep = [c for c in docs.columns if c.lower() not in low or c == column]
    stay = [c for c in keep if c.lower() not in low]
    out_names = stay + names
    frame = docs.select(*[named(c) for c in keep])
    schema = docs.select(*[named(c) for c in stay]).schema
    for x in new.split(", "):
        name, kind = x.split(" ", 1)
        schema = schema.add(name, DataType.fromDDL(kind))
    at = keep.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(_codec(key, lambda: sent.value), batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, keep) if n in stay] + made, names=out_names)

    return map_batches(frame, run, schema)
