"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Each rule looks at one text and votes good (1), bad (0) or abstains (null). Without labels, expectation-maximisation
finds each rule's two accuracies (votes on good texts, votes on bad ones) and the share of good texts. A text stays if
its posterior probability of being good reaches ``threshold``; rules need not all pass.

The rows are never gathered: the texts' vote patterns are counted by Spark, and there are at most 3 ** len(RULES) of
them, whatever the input. EM runs over these counts.
"""

from __future__ import annotations

import math
import operator
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import map_batches, named, prepare, saved

SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
#: Bytes that begin no code point, and so count no character.
_INNER = bytes(range(0x80, 0xC0))
_UPPER, _LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
_LETTER = re.compile(rb"[A-Za-z]")
_OTHER = re.compile("[^\x00-\x7f]")

#: Sentence ends of other scripts, and characters of scripts that put no space between words.
_STOPS = re.compile("[\u3002\uff01\uff1f\uff0e\u061f\u06d4\u0964\u0965\u1362\u0589]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_upper long, n_letters long, n_stops long, n_lower long, n_caseless long, n_unspaced long, n_echoes long, n_short long, n_wordless long"

#: name, the measure, least value for a bad vote, greatest value for a good vote; in between, and without a value, a rule abstains.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("symbols", "try_divide(n_symbols, n_words)", 0.1, 0.02),
    ("letters", "1 - try_divide(n_letters, word_chars)", 0.25, 0.08),
    ("shouting", "if(2 * n_caseless > n_words, null, try_divide(n_upper, n_letters))", 0.25, 0.05),
    ("repeats", "if(n_words < 20, null, try_divide(n_repeat_words, n_words))", 0.1, 0.0),
    ("dup_lines", "if(n_lines < 3, null, try_divide(n_dup_lines, n_lines))", 0.25, 0.0),
    ("echoes", "try_divide(n_echoes, n_words)", 0.1, 0.03),
    ("word_length", "if(2 * n_unspaced > word_chars, null, abs(try_divide(word_chars, n_words) - 5.5))", 2.0, 1.0),
    ("sentences", "if(2 * n_unspaced > word_chars, null, n_words / (n_stops + 1))", 35.0, 16.0),
    ("few_lower", "1 - try_divide(n_lower, n_words - n_caseless)", 0.4, 0.15),
    ("wordless", "try_divide(n_wordless, n_words)", 0.2, 0.05),
    ("few_short", "if(2 * n_unspaced > word_chars, null, 1 - try_divide(n_short, n_words))", 0.9, 0.8),
)
#: Where EM begins, and what it is drawn to a little: probabilities of a bad vote, none and a good vote, on bad texts and on good ones.
PRIOR = ((0.4, 0.3, 0.3), (0.05, 0.25, 0.7))
#: The one bound on accuracies, which only keeps the classes' sense: a vote is so many times likelier where it is right.
LEAST_RATIO = 1.05


def _measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, see ``features``."""
    if not text:
        return (0,) * 15
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _INNER + _SPACE))
    windows = n - 4
    repeated = 0
    if windows > 1:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < windows:
            first: dict = {}
            hit = np.zeros(n, dtype=bool)
            for i, g in enumerate(grams):
                j = first.setdefault(g, i)
                if j != i:
                    hit[i : i + 5] = True
                    hit[j : j + 5] = True
            repeated = int(hit.sum())
    lines = [x for x in raw.split(b"\n") if x.split()]
    plain = text.isascii()
    other = [] if plain else _OTHER.findall(text)
    upper = len(raw) - len(raw.translate(None, _UPPER)) + sum(map(str.isupper, other))
    letters = len(raw) - len(raw.translate(None, _LETTERS)) + sum(map(str.isalpha, other))
    stops = sum(1 for w in words if w.endswith((b".", b"?", b"!")) and not w.endswith((b"!!", b"!!.")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    echoes = sum(map(operator.eq, words, words[1:]))
    lower = caseless = unspaced = short = wordless = 0
    for w in words:
        if w.isascii():
            lower += w.islower()
            wordless += not w.isalpha() and _LETTER.search(w) is None
            short += len(w) < 4
        else:
            x = w.decode("utf-8", "surrogatepass")
            lower += x.islower()
            short += len(x) < 4
            # Letters, and none of them with a case: neither lower nor not.
            caseless += x.lower() == x.upper() and any(map(str.isalpha, x))
    if not plain:
        stops += len(_STOPS.findall(text))
        unspaced = len(_UNSPACED.findall(text))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, stops, lower, caseless, unspaced, echoes, short, wordless


def features(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the measures of its whole ``text`` in BASE and MORE, and without the text unless ``keep_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty; all its measures are 0. Of a repeated line each
    copy after the first counts, of a repeated 5-word window every word of every copy. Columns of ``docs`` that have
    a measure's name, in whatever case, are replaced.
    """
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in f"{BASE}, {MORE}".split(", ")]
    keep = [c for c in docs.columns if (keep_text or c != text) and c.lower() not in names]
    frame = docs.select(*[named(c) for c in keep], named(text).cast("string").alias("__text"))
    schema = frame.drop("__text").schema
    for n in names:
        schema = schema.add(n, "long", False)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(_measure, batch.column(batch.num_columns - 1).to_pylist())))
        return pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c, pa.int64()) for c in cols], names=keep + names)

    return map_batches(frame, measure, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Texts of under 10 words, or with over 20 of 100 words in repeated 5-word windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def vote(rule: tuple[str, str, float, float]) -> Column:
    """2 for good, 0 for bad, 1 for abstaining (also where the measure has no value)."""
    _, measure, bad, good = rule
    x = F.expr(measure)
    return F.when(x >= bad, 0).when(x <= good, 2).otherwise(1)


def fit_votes(patterns: list[tuple[str, int]], rounds: int = 500, tolerance: float = 1e-10, strength: float = 0.01) -> tuple[float, np.ndarray]:
    """EM over counted vote patterns: the share of good texts and, by rule, class (bad, good) and vote, probabilities.

    Rules are taken to be independent given the class; one that abstains says nothing. PRIOR counts as ``strength``
    times the texts in either class. No patterns: the start.
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    prior = np.tile(np.array(PRIOR), (k, 1, 1))
    prob, share = prior.copy(), 0.8
    if not patterns:
        return share, prob
    votes = np.array([[int(c) for c in p] for p, _ in patterns])
    count = np.array([float(c) for _, c in patterns])
    hot = (votes[:, :, None] == np.arange(3)[None, None, :]).astype(float)
    last = -math.inf
    for _ in range(rounds):
        # An abstaining rule is as likely on either side: its column adds nothing.
        logs = np.einsum("pkv,ckv->pc", hot[:, :, [0, 2]], np.log(prob[:, :, [0, 2]]).transpose(1, 0, 2)) + np.log([1 - share, share])
        top = logs.max(1, keepdims=True)
        seen = np.exp(logs - top)
        post = seen / seen.sum(1, keepdims=True)
        level = float((count * (top[:, 0] + np.log(seen.sum(1)))).sum() / count.sum())
        share = float(np.clip((count * post[:, 1]).sum() / count.sum(), 0.01, 0.99))
        for c in (0, 1):
            sums = np.einsum("p,pkv->kv", count * post[:, c], hot) + strength * count.sum() * prior[:, c] + 1e-6
            prob[:, c, :] = sums / sums.sum(1, keepdims=True)
        for v, right, wrong in ((0, 0, 1), (2, 1, 0)):
            turned = prob[:, right, v] < LEAST_RATIO * prob[:, wrong, v]
            mean = np.sqrt(prob[turned, right, v] * prob[turned, wrong, v])
            prob[turned, right, v], prob[turned, wrong, v] = mean * math.sqrt(LEAST_RATIO), mean / math.sqrt(LEAST_RATIO)
        if abs(level - last) < tolerance:
            break
        last = level
    return share, prob


def posterior(share: float, prob: np.ndarray) -> Column:
    """The probability that a text with votes ``v0 .. vk`` is good."""
    odds = F.lit(math.log(share / (1 - share)))
    weights = np.log(prob[:, 1] / prob[:, 0])
    for j, (bad, _, good) in enumerate(weights.tolist()):
        odds = odds + F.when(F.col(f"__v{j}") == 0, bad).when(F.col(f"__v{j}") == 2, good).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"__v{j}": vote(r) for j, r in enumerate(RULES)})


def fit(measured: DataFrame) -> tuple[float, np.ndarray]:
    """EM over a table of measures: its vote patterns, 3 ** len(RULES) at most, are counted by Spark."""
    pattern = F.concat(*[F.col(f"__v{j}").cast("string") for j in range(len(RULES))])
    counted = _votes(measured).groupBy(pattern.alias("p")).agg(F.count("*").alias("n")).collect()
    return fit_votes(sorted((r["p"], r["n"]) for r in counted))


def judged(measured: DataFrame, share: float, prob: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """``measured`` with ``base_failed``, ``posterior`` and ``kept``."""
    out = _votes(measured).withColumns({"posterior": posterior(share, prob), "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*[f"__v{j}" for j in range(len(RULES))])


def apply(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` but its text, the measures, ``base_failed``, ``posterior`` and ``kept``.

    ``kept`` is false where ``base_failed``, else whether ``posterior`` reaches ``threshold``. Rows are judged one by
    one: repeated rows and equal texts get equal verdicts. Columns of ``docs`` with these names are replaced. An empty table gives an empty result.
    """
    clash = ("posterior", "base_failed", "kept")
    measured = saved(features(docs.select(*[named(c) for c in docs.columns if c.lower() not in clash]), text))
    return judged(measured, *fit(measured), threshold)


def filtered(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``apply`` keeps, with their columns as they were."""
    share, prob = fit(features(docs.select(named(text)), text))
    # Measured again beside the texts: that costs less than to join or to write them once more.
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = judged(features(docs.withColumnsRenamed(names), names[text], keep_text=True), share, prob, threshold)
    return out.where("kept").select(*[F.col(new).alias(old) for old, new in names.items()])
