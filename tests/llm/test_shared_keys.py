"""Rows that share keys or have none, clashing digests and column names, and votes against a slow twin."""

import math

import numpy as np
import pytest

from opsloom.llm import line_dedup, quality_rules, sentencepiece_codec, substring_dedup
from opsloom.llm.queries import PIECE_MODEL

PASSAGE = " ".join(f"passage{i * 7919 % 1013:04d}" for i in range(60))
OWN = ["abcd"[j] + " ".join(f"own{i * 104729 % 9973:05d}{j}" for i in range(80)) for j in range(4)]


def test_shared_and_null_keys_keep_one_copy_of_a_passage(spark):
    texts = [(1, f"{OWN[0]} {PASSAGE} ende"), (1, f"這{OWN[1]} 中文 {PASSAGE} 末"), (None, f"{OWN[2]} {PASSAGE} x"), (None, f"{PASSAGE} {OWN[3]}!"), (7, None), (8, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    left = [r["text"] for r in substring_dedup.remove(docs, substring_dedup.repeated_passages(docs)).collect()]
    assert sum(PASSAGE in (t or "") for t in left) == 1
    for own in OWN:
        assert sum(own in (t or "") for t in left) == 1  # no two end or begin alike
    assert sum(t is None for t in left) == 1 and len(left) == 6


def test_passages_of_51_words_are_found_whole_but_for_a_few_bytes(spark):
    g = np.random.Generator(np.random.PCG64(5))
    word = lambda: "".join(chr(97 + x) for x in g.integers(0, 26, int(g.integers(3, 8))))
    rows, spans = [], {}
    for i in range(60):
        passage = " ".join(word() for _ in range(51))
        for half in (0, 1):
            before = " ".join(word() for _ in range(40)) + " "
            rows.append((2 * i + half, before + passage + " " + " ".join(word() for _ in range(40))))
            spans[2 * i + half] = (len(before), len(passage))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["k"] for r in found} <= set(range(1, 120, 2))
    covered = {i: 0 for i in range(1, 120, 2)}
    for r in found:
        a, n = spans[r["k"]]
        assert a - 6 <= r["start"] and r["start"] + r["size"] <= a + n + 6  # a few bytes around are equal by chance
        covered[r["k"]] += r["size"] / n
    assert sum(x > 0.7 for x in covered.values()) >= 58 and np.mean(list(covered.values())) > 0.9


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_clashing_digests_cost_no_line(spark, digest_bytes):
    shared = "\n".join(f"shared line {i}" for i in range(4))
    texts = [(i, "\n".join(f"line {i} {j}" for j in range(40)) + ("\n" + shared if i % 3 == 0 else "")) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.apply(docs, extend=True, digest_bytes=digest_bytes).collect()}
    for i, t in texts:
        assert out[i] == (t if i == 0 or i % 3 else t[: -len(shared) - 1])


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", 5, 6, 7)], "`doc_id` long, text string, `N_WORDS` int, `a.b` int, `__lines` int")
    assert quality_rules.apply(docs).count() == 1
    assert quality_rules.filtered(docs).columns == docs.columns
    assert line_dedup.apply(docs).columns == [*docs.columns, "n_removed_lines", "n_removed_chunks"]
    coded = sentencepiece_codec.encode(docs.withColumnRenamed("N_WORDS", "IDS"), PIECE_MODEL)
    assert coded.columns == ["doc_id", "text", "a.b", "__lines", "ids"]
    assert substring_dedup.remove(docs, substring_dedup.repeated_passages(docs)).collect()[0]["a.b"] == 6


def _slow_em(patterns, rounds):
    """EM one text and rule at a time."""
    k = len(patterns[0])
    p = [[list(side) for side in quality_rules.PRIOR] for _ in range(k)]
    share, n = 0.8, len(patterns)
    for _ in range(rounds):
        post = []
        for v in patterns:
            good, bad = share, 1 - share
            for j, c in enumerate(v):
                if c != "1":
                    good, bad = good * p[j][1][int(c)], bad * p[j][0][int(c)]
            post.append(good / (good + bad))
        share = min(0.99, max(0.01, sum(post) / n))
        for j in range(k):
            for side in (0, 1):
                sums = [0.01 * n * quality_rules.PRIOR[side][v] + 1e-6 for v in range(3)]
                for v, w in zip(patterns, post):
                    sums[int(v[j])] += w if side else 1 - w
                p[j][side] = [x / sum(sums) for x in sums]
            for v, right in ((0, 0), (2, 1)):
                a, b = p[j][right][v], p[j][1 - right][v]
                if a < quality_rules.LEAST_RATIO * b:
                    mean = math.sqrt(a * b)
                    p[j][right][v], p[j][1 - right][v] = mean * math.sqrt(quality_rules.LEAST_RATIO), mean / math.sqrt(quality_rules.LEAST_RATIO)
    return share, p


def test_em_against_a_slow_twin():
    g = np.random.Generator(np.random.PCG64(2))
    patterns = ["".join("0" if (x < 0.7) == bad and x < 0.9 else "2" if x < 0.95 else "1" for x in g.random(5)) for bad in g.random(300) < 0.3]
    counted = {p: patterns.count(p) for p in set(patterns)}
    share, prob = quality_rules.fit_votes(sorted(counted.items()), rounds=25, tolerance=0.0)
    slow_share, slow = _slow_em(patterns, 25)
    assert share == pytest.approx(slow_share, abs=1e-9) and prob == pytest.approx(np.array(slow), abs=1e-9)


def test_one_bad_vote_does_not_decide(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = quality_rules.apply(docs).where("not base_failed")
    bad = sum((quality_rules.vote(r) == 0).cast("int") for r in quality_rules.RULES)
    seen = {(r["bad"], r["kept"]) for r in out.select(bad.alias("bad"), "kept").distinct().collect()}
    assert (1, True) in seen and any(k and not kept for k, kept in seen)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {r["quality"]: r["kept"] for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2
