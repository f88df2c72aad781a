"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from opsloom.llm import license_scan, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup
from opsloom.llm.queries import PIECE_MODEL

DOCS = "doc_id long, text string, `n_words` string, digest string, k string"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "w", "d", "k") for i, t in enumerate(texts)], schema)


EDGE = [None, "", " \n\t ", "one", "a b c d e", "a b c d e", "x " * 30_000, "é" * 500, "\n".join(["same line here"] * 5)]


def words_of(text):
    return (text or "").encode().split()


# -- quality rules


def brute_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    hit = set()
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    for where in at.values():
        if len(where) > 1:
            for i in where:
                hit |= set(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if __import__("re").search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_measures(spark):
    random.seed(2)
    texts = EDGE + ["".join(random.choice("ab \n#é\x0b\x1f ") for _ in range(random.randint(0, 300))) for _ in range(60)]
    out = quality_rules.apply(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts):
        want = brute_measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["digest"] == "d" and not (r["kept"] and r["base_failed"])


def test_quality_rules_agree_with_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = quality_rules.apply(docs).where("n_words >= 10").join(labels, "doc_id")
    rows = measured.select("quality", "kept", "base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows if not r["base_failed"]) >= 0.95 * sum(not r["base_failed"] for r in rows)
    assert kept.count() == quality_rules.apply(docs).where("kept").count()


def test_quality_em_finds_planted_accuracies():
    g = np.random.Generator(np.random.PCG64(1))
    good = g.random(20_000) < 0.8
    bad_rate = [0.5, 0.4, 0.45, 0.4, 0.3, 0.5, 0.5]
    votes = np.ones((20_000, 7), dtype=int)
    for j, rate in enumerate(bad_rate):
        votes[:, j] = np.where(~good & (g.random(20_000) < rate), 0, 1)
        if quality_rules.RULES[j][3] is not None:
            votes[:, j] = np.where((votes[:, j] == 1) & (g.random(20_000) < np.where(good, 0.9, 0.3)), 2, votes[:, j])
    counted = collections.Counter("".join(map(str, v)) for v in votes.tolist())
    share, prob = quality_rules.fit_votes(sorted(counted.items()))
    assert abs(share - 0.8) < 0.06
    assert all(abs(prob[j, 0, 0] - r) < 0.12 for j, r in enumerate(bad_rate))
    assert quality_rules.fit_votes([])[0] == 0.8


# -- line dedup


def test_line_chunks_resist_shifts():
    random.seed(4)
    lines = [f"line {random.random()}".encode() for _ in range(300)]
    cut = lambda ls: {b"\n".join(ls[a:b]) for a, b in zip([0, *line_dedup.chunk_bounds(ls)], line_dedup.chunk_bounds(ls))}
    assert len(cut(lines) - cut([b"new", *lines])) <= 2
    assert len(cut(lines) - cut(lines[:100] + [b"new"] + lines[100:])) <= 3
    assert line_dedup.chunk_bounds([]) == []


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        if not t:
            out.append((t, 0))
            continue
        lines, left, n, at = t.encode().split(b"\n"), [], 0, 0
        for end in line_dedup.chunk_bounds(lines):
            body = b"\n".join(lines[at:end])
            multi = end - at > 1 and body.split()
            if multi and body in seen:
                n += end - at
            else:
                left += lines[at:end]
                if multi:
                    seen.add(body)
            at = end
        out.append((b"\n".join(left).decode(), n))
    return out


def test_line_dedup(spark):
    random.seed(5)
    pool = [f"sentence number {i} of the pool" for i in range(40)]
    passage = [f"shared passage line {i}" for i in range(12)]
    texts = list(EDGE)
    for i in range(60):
        own = [random.choice(pool) if random.random() < 0.2 else f"own line {i} {j}" for j in range(random.randint(1, 15))]
        if i % 3 == 0:
            own[random.randint(0, len(own)) : 0] = passage
        texts.append("\n".join(own))
    texts.append(texts[-1])
    rows = line_dedup.apply(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["text"], r["n_removed_lines"]) for r in rows] == brute_lines(texts)
    assert sum(r["n_removed_lines"] for r in rows) > 100 and rows[0]["digest"] == "d"


# -- n-gram join


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, base, n, rate):
    random.seed(seed)
    words = [f"w{random.randint(0, 10**6)}" for _ in range(base)]
    return [" ".join(f"x{random.randint(0, 10**6)}" if random.random() < rate else w for w in words) for _ in range(n)]


@pytest.mark.parametrize("unit", [2_000_000, 3_000])
def test_ngram_join(spark, monkeypatch, unit):
    monkeypatch.setattr(ngram_join, "UNIT", unit)  # the small one sends the large group through blocks
    texts = EDGE + near_copies(1, 120, 40, 0.01) + near_copies(2, 40, 30, 0.02) + near_copies(3, 300, 20, 0.03) + ["A b C d e", "a b c d"]
    got = sorted(tuple(r) for r in ngram_join.apply(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(texts)


def test_ngram_search_is_exact_and_small():
    sets = [np.unique(np.random.Generator(np.random.PCG64(i % 7)).integers(0, 10**9, 50) + (np.arange(50) < i // 7) * i) for i in range(60)]
    found = ngram_join.search(sets)
    linked = {(i, j) for i in range(60) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    assert all((max(a, b), min(a, b)) in linked for a, b in found) and len(found) < 60
    assert ngram_join.search([]) == [] and ngram_join.search([np.empty(0, dtype=np.int64)]) == []


def test_deduplicated_keeps_one_of_each_group(spark):
    texts = near_copies(1, 100, 10, 0.005) + ["alone here with some more words", None, ""]
    docs = frame(spark, texts)
    kept = ngram_join.deduplicated(docs.union(docs.where("doc_id = 10")))
    want = {c for _, _, c in brute_components(texts)}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert ngram_join.deduplicated(nulls).count() == 3


# -- substring dedup


def test_gear_cuts_resist_shifts_and_keep_characters_whole():
    data = "".join(random.Random(3).choice("abcdefghij éß漢 ") for _ in range(5000)).encode()
    cut = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.cut_points(d)], substring_dedup.cut_points(d))}
    assert b"".join(data[a:b] for a, b in zip([0, *substring_dedup.cut_points(data)], substring_dedup.cut_points(data))) == data
    assert len(cut(data) - cut(b"inserted" + data)) <= 3
    for piece in cut(data):
        piece.decode()
    flat = "漢".encode() * 9000
    assert substring_dedup.cut_points(flat)[-1] == len(flat) and all(e % 3 == 0 for e in substring_dedup.cut_points(flat))
    assert substring_dedup.cut_points(b"") == []


def test_repeated_passages(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(random.randint(1, 120))) for _ in range(80)]
    for i in (5, 20, 33, 70):
        texts[i] = texts[i] + " " + passage + " " + word()
    texts += [None, "", texts[5]]
    docs = frame(spark, texts)
    found = substring_dedup.repeated_passages(docs)
    rows = found.collect()
    assert {r["k"] for r in rows} == {20, 33, 70, 82} and {r["first_k"] for r in rows} == {5}
    for r in rows:
        assert texts[r["k"]].encode()[r["start"] : r["start"] + r["size"]].decode() in texts[5]
    cleaned = {r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, found).collect()}
    assert len(cleaned) == len(texts) and cleaned[5] == texts[5] and len(cleaned[82]) < 40 and cleaned[80] is None
    assert len(cleaned[20]) < len(texts[20]) - 200


# -- sentencepiece


def test_pieces_equal_the_public_library(spark, sf_dir):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    random.seed(1)
    made = ["".join(random.choice("ab e  tthing\n\t한글éßﬁ🎉▁") for _ in range(random.randint(0, 120))) for _ in range(300)]
    texts = EDGE + made + ["a" * 3000, "the" * 300, " " * 40, "x" * 100 + " " * 33 + "\n\n"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = frame(spark, texts)
    coded = sentencepiece_codec.encode(docs, PIECE_MODEL)
    rows = coded.orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r["ids"] == (None if t is None else lib.encode(t)) and r["k"] == "k"
    back = sentencepiece_codec.decode(coded, PIECE_MODEL, text="text").orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [None if t is None else lib.decode(lib.encode(t)) for t in texts]
    told = sentencepiece_codec.digest(docs, PIECE_MODEL).orderBy("doc_id").collect()
    for r, t in zip(told, texts):
        assert r["round_trip"] == (None if t is None else "▁" not in t)
        if t is not None:
            ids = np.array(lib.encode(t), dtype="<i4")
            assert (r["n_pieces"], r["ids_digest"]) == (len(ids), hashlib.sha1(ids.tobytes()).hexdigest())


def unigram_model(pieces):
    """A model file of a unigram vocabulary, byte by byte."""

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def text(b):
        return bytes([len(b)]) + b

    out = field(1, 2, text(field(1, 2, text(b"<unk>")) + field(3, 0, b"\x02")))
    for p, s in pieces:
        out += field(1, 2, text(field(1, 2, text(p.encode())) + field(2, 5, np.float32(s).tobytes())))
    out += field(2, 2, text(field(3, 0, b"\x01")))
    return out + field(3, 2, text(field(1, 2, text(b"identity")) + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")))


def test_unigram_viterbi_equals_the_public_library(monkeypatch):
    random.seed(6)
    seen = {"▁": -3.0, **{c: -4.0 - i / 7 for i, c in enumerate("abcde")}}
    while len(seen) < 150:
        seen.setdefault(random.choice(["", "▁"]) + "".join(random.choice("abcde") for _ in range(random.randint(2, 5))), -random.uniform(2, 12))
    data = unigram_model(seen.items())
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(data))
    texts = ["".join(random.choice("abcdex  ") for _ in range(random.randint(1, 80))) for _ in range(300)] + ["abcde" * 60]
    for t, ids in zip(texts, codec.encode(texts)):
        want = lib.encode(t)
        score = lambda x: sum(lib.get_score(i) for i in x)
        assert list(ids) == want or abs(score(ids) - score(want)) < 1e-4


# -- quality classifier


def test_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.apply(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    assert out.where("not held_out <=> (crc32(cast(doc_id as string)) % 5 <> 0)").count() == out.count()
    assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_quality_classifier_edges(spark):
    docs = frame(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.apply(docs, none).collect()
    assert len(out) == len(EDGE) and all(r["score"] == 0.5 for r in out)
    assert quality_classifier.apply(docs.limit(0), none).count() == 0


# -- licences

MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = "words.\nLicensed under the Apache License, Version 2.0.\nmore words"


def test_license_scan(spark):
    import duckdb

    texts = EDGE + [MIT, APACHE, "# SPDX-License-Identifier: MIT\n" + APACHE, "a licence of no kind", "Released under the MIT License.\n" + MIT]
    out = license_scan.apply(frame(spark, texts)).orderBy("doc_id")
    rows = out.collect()[len(EDGE) :]
    assert [r["licenses"] for r in rows] == ["MIT", "Apache-2.0", "Apache-2.0,MIT", "", "MIT"]
    assert rows[0]["sentence_ids"] == "mit-grant,mit-keep,mit-warranty,mit-liability"
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.sql(license_scan.oracle_sql()).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


# -- mixing


def brute_rates(p, n, goal, steps=20_000):
    """Projected gradient with small steps on the same weighted squares."""
    total = n.sum()
    inverse = np.linalg.pinv((p * n[:, None]).T @ p / total)
    r = np.ones(len(p))
    for _ in range(steps):
        r = np.maximum(0, r - 0.2 * p @ (inverse @ ((r * n) @ p / total - goal)))
    return r


@pytest.mark.parametrize("targets", [(0.9, 0.05, 0.05), (0.3, 0.3, 0.4)])
def test_mixing_meets_targets(spark, sf_dir, targets):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mixing.apply(docs, labels, targets).toPandas()
    p, n = out[["p_0", "p_1", "p_2"]].to_numpy(), out["n_tokens"].to_numpy(dtype=float)
    assert np.allclose(p.sum(1), 1) and (out["rate"] >= 0).all() and len(out) == docs.count()
    got = (out["rate"].to_numpy() * n) @ p / n.sum()
    want = brute_rates(p, n, np.array(targets))
    assert np.abs(got - np.array(targets)).max() <= np.abs((want * n) @ p / n.sum() - np.array(targets)).max() + 1e-3
    mixed = mixing.mixed(docs, labels, targets)
    assert mixed.columns == docs.columns and 0.7 * docs.count() < mixed.count() < 1.3 * docs.count() + 100


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.apply(frame(spark, EDGE), mixing.label_domains(labels)).collect()
    assert len(out) == len(EDGE) and all(r["rate"] >= 0 for r in out)
    assert mixing.apply(frame(spark, EDGE).limit(0), mixing.label_domains(labels)).count() == 0
    assert mixing.mixed(frame(spark, [None, ""]), mixing.label_domains(labels.limit(0))).columns == ["doc_id", "text", "n_words", "digest", "k"]


@pytest.mark.parametrize("run", [
    lambda d: quality_rules.apply(d), lambda d: quality_rules.filtered(d), line_dedup.apply, ngram_join.apply, ngram_join.deduplicated, substring_dedup.repeated_passages,
    license_scan.apply, lambda d: sentencepiece_codec.digest(d, PIECE_MODEL),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("run", [lambda d: quality_rules.apply(d), line_dedup.apply, ngram_join.apply, license_scan.apply, lambda d: sentencepiece_codec.digest(d, PIECE_MODEL)])
def test_null_ids_and_repeated_rows_stay(spark, run):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a\nb\nc\nd\ne\nf"), (1, "a\nb\nc\nd\ne\nf"), (None, None)], "doc_id long, text string")
    assert run(docs).count() == 4
