"""Mixing sources to target weights: soft domain membership, then least squares for rates of documents.

A naive Bayes classifier over hashed words and word ends, learnt from a labelled table, gives each document a posterior
over domains. A document of t tokens and posterior p adds ``rate * t * p`` expected tokens to the domains. Projected
gradient finds nonnegative rates whose expected totals match the targets: the squares are weighted by the inverse of
the totals' normal matrix, for which a step of length 1 is safe, and a rate's step is the posterior's product with the
weighted residual, with momentum. So a rate follows from its document's posterior and the residuals of all steps, a few numbers each;
every step is one aggregate over the documents. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import named, prepare, saved

#: What ends a token here: white space and light punctuation.
SPLIT = "[\\x20\\x09-\\x0D.,;:?]+"
#: Labelled documents to learn from at most (those whose ids hash lowest); buckets of words and of word ends.
SAMPLE, WORDS, ENDS = 20_000, 1 << 15, 1024
#: Weight of a document's evidence: words are not independent, and posteriors are to stay soft.
EVIDENCE = 0.8
#: Tokens from which on absent words count in full.
FULL = 100.0
#: Documents that each domain has besides, like those of all domains; that hold a bucket all the same; how many standard deviations a bucket's
#: documents must be off the expected number for it to count.
SMOOTH, RARE, SIGNIFICANT = 5.0, 2.0, 5.0
#: Share of some domain's documents that a bucket needs to count; shingle hashes by which copies are told.
SUPPORT, COPY_KEYS = 0.02, 6
#: A guard against steps without end, the residual (share of all tokens) that ends them, and the least part of it that a step must take off.
STEPS, CLOSE, PROGRESS = 400, 1e-6, 0.001
#: Domains of the labels table, and the weights asked for.
DOMAINS = ("clean", "low", "toxic")
TARGETS = (0.90, 0.05, 0.05)


@dataclass
class Mixture:
    """By domain but the first: log-odds of words and ends that are there, of all of them being absent, and prior odds."""

    words: np.ndarray
    ends: np.ndarray
    absent: np.ndarray
    prior: np.ndarray


def tokens(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPLIT), lambda w: w != "")


def _word(w: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(w)), F.lit(WORDS)).cast("int")


def _end(w: Column) -> Column:
    return F.pmod(F.xxhash64(F.right(w, F.lit(2))), F.lit(ENDS)).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: 2 toxic, 1 of low quality, 0 clean; rows with nulls are left out."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", domain.alias("domain"))


def toxic_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) with 1 for toxic and 0 for other documents; rows with nulls are left out."""
    return labels.where("doc_id is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("domain"))


def _least_hash(seed: int) -> Column:
    return F.array_min(F.transform("h", lambda h: F.xxhash64(h, F.lit(seed))))


def learn(docs: DataFrame, domains: DataFrame, key: str, text: str, n_domains: int, most: int = SAMPLE) -> Mixture:
    """The classifier. An id with several domains teaches none; without labelled documents posteriors are the priors."""
    one = domains.groupBy(F.col("doc_id").alias("__id")).agg(F.min("domain").alias("__d"), F.max("domain").alias("__e")).where("__d = __e")
    one = one.select("__id", "__d").orderBy(F.xxhash64("__id"), "__id").limit(most)
    taken = docs.select(F.col(key).alias("__k"), tokens(text).alias("w")).join(F.broadcast(one), F.col("__k") == F.col("__id"))  # ``most`` rows bound the broadcast
    # Copies would count as many witnesses: a document teaches only if none before it shares one of its least shingle hashes.
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5)))
    taken = saved(taken.select("__id", F.col("__d").alias("d"), windows.alias("h"), F.array_distinct("w").alias("w")))
    least = F.array(*[_least_hash(i) for i in range(COPY_KEYS)])
    order = F.struct(F.xxhash64("__id").alias("x"), F.col("__id").alias("y"))
    keys = taken.select("__id", order.alias("o"), F.posexplode(least).alias("i", "key"))
    first = keys.withColumn("first", F.min("o").over(Window.partitionBy("i", "key"))).groupBy("__id").agg(F.bool_and(F.col("o") == F.col("first")).alias("own"))
    taken = saved(taken.join(F.broadcast(first.where("own").select("__id")), "__id").select("d", "w"))
    size = np.zeros(n_domains)
    for r in taken.groupBy("d").count().collect():
        size[r["d"]] = r["count"]
    buckets = F.array_union(F.transform("w", _word), F.transform("w", lambda w: _end(w) + WORDS))
    both = taken.select("d", F.explode(buckets).alias("b"))  # each bucket of a document once
    counts = np.zeros((n_domains, WORDS + ENDS))
    found = both.groupBy("d", "b").count().toPandas()  # n_domains * (WORDS + ENDS) rows at most
    counts[found["d"], found["b"]] = found["count"]

    share = counts.sum(0) / max(size.sum(), 1.0)  # of all documents that hold a bucket
    p = (counts + SMOOTH * share + RARE) / (size + SMOOTH + 2 * RARE)[:, None]
    absent = np.log((1 - p[1:]) / (1 - p[0]))
    odds = np.log(p[1:] / p[0]) - absent
    expected = size[:, None] * share
    far = np.abs(counts - expected) / np.sqrt(np.maximum(expected * (1 - share), 0.5))
    odds[(np.maximum(far[1:], far[0]) < SIGNIFICANT) | (np.maximum(counts[1:] / np.maximum(size[1:], 1)[:, None], counts[0] / max(size[0], 1)) < SUPPORT)] = 0.0
    absent[odds == 0.0] = 0.0
    prior = np.log((size[1:] + 1) / (size[0] + 1))
    return Mixture(odds[:, :WORDS], odds[:, WORDS:], absent.sum(1), prior)


def _constant(values: np.ndarray) -> Column:
    """An array literal: one string that the optimiser turns into an array once."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values.tolist())), ",").cast("array<double>")


def _evidence(buckets: Column, odds: np.ndarray) -> Column:
    known = _constant(odds)
    return F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(known, b))


def with_posteriors(df: DataFrame, mix: Mixture, text: str) -> DataFrame:
    """``df`` with __n (tokens), __p0, __p1, ... (posteriors). A word counts once in a document, as in the learning."""
    out = df.withColumn("__w", tokens(text))
    out = out.withColumns({"__n": F.size("__w").cast("long"), "__b": F.array_distinct(F.transform("__w", _word)), "__e": F.array_distinct(F.transform("__w", _end))})
    whole = F.least(F.lit(1.0), F.col("__n") / FULL)  # a short document is not known by what it lacks
    logits = [F.lit(0.0)]
    for w, e, absent, prior in zip(mix.words, mix.ends, mix.absent.tolist(), mix.prior.tolist()):
        logits.append(prior + EVIDENCE * (_evidence(F.col("__b"), w) + _evidence(F.col("__e"), e) + absent * whole))
    out = out.withColumns({f"__l{k}": c for k, c in enumerate(logits)}).drop("__w", "__b", "__e")
    names = [f"__l{k}" for k in range(len(mix.prior) + 1)]
    top = F.greatest(*names)
    out = out.withColumn("__top", top).withColumns({x: F.exp(F.col(x) - F.col("__top")) for x in names})
    total = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    return out.withColumns({f"__p{k}": F.col(x) / total for k, x in enumerate(names)}).drop(*names, "__top")


@dataclass
class Fit:
    """The steps, how far the shares of expected tokens are off the targets (the largest difference), and whether they meet them."""

    steps: list[list[float]]
    residual: float = 0.0
    converged: bool = True


def rate(steps: list[list[float]], n_domains: int) -> Column:
    """The rate after ``steps``, see ``fit``: it starts at 1, and what each step leaves is projected to what is not negative."""
    if not steps:
        return F.lit(1.0)

    def step(at: Column, g: Column) -> Column:
        ahead = at["r"] + g[n_domains] * (at["r"] - at["before"])
        down = sum((at["p"][k] * g[k] for k in range(1, n_domains)), at["p"][0] * g[0])
        return F.struct(F.greatest(F.lit(0.0), ahead - down).alias("r"), at["r"].alias("before"), at["p"].alias("p"))

    # The posteriors go along in the state: a column named inside the function could be worked out anew at each step.
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"), F.array(*[F.coalesce(F.col(f"__p{k}"), F.lit(0.0)) for k in range(n_domains)]).alias("p"))
    return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in steps]), start, step, lambda at: at["r"])


def fit(scored: DataFrame, targets: tuple[float, ...], most_steps: int = STEPS) -> Fit:
    """The steps for a table with __n and __p columns; targets are weights of the domains, which need not sum to 1.

    A step is the gradient's weights by domain and the momentum: the gradient is taken at the rates moved on by so
    much of their last change. Totals are linear in the rates, so those of the moved rates need no pass of their own.
    Momentum starts anew where a step has brought next to nothing; where one without it has not either, the steps end:
    the least squares are reached, whether they meet the targets or not. ``most_steps`` is a guard, not the usual end.
    """
    k = len(targets)
    p = [F.col(f"__p{i}") for i in range(k)]
    sums = scored.agg(F.sum("__n").alias("n"), *[F.sum(F.col("__n") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = float(sums["n"] or 0)
    if not total:
        return Fit([])
    normal = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float) / total
    inverse = np.linalg.pinv(normal, rcond=1e-12, hermitian=True)
    goal = np.array(targets, dtype=float) / sum(targets)
    steps: list[list[float]] = []
    last, age, momentum, before = np.inf, 1.0, 0.0, None
    while True:
        r = rate(steps, k)
        row = scored.agg(*[F.sum(r * F.col("__n") * p[i]).alias(f"s{i}") for i in range(k)]).first()
        now = np.array([row[f"s{i}"] for i in range(k)]) / total
        rest = now - goal
        off = float(np.sqrt(max(0.0, rest @ inverse @ rest)))  # what the steps make smaller
        if np.abs(rest).max() < CLOSE or len(steps) == most_steps:
            break
        if off > (1 - PROGRESS) * last:
            if not momentum:
                break
            age = 1.0
        last, older = off, age
        age = (1 + math.sqrt(1 + 4 * age * age)) / 2
        momentum = (older - 1) / age
        ahead = rest if before is None else rest + momentum * (now - before)
        before = now
        steps.append([*(inverse @ ahead).tolist(), momentum])
    return Fit(steps, float(np.abs(rest).max()), bool(np.abs(rest).max() < CLOSE))


def apply(docs: DataFrame, domains: DataFrame, targets: tuple[float, ...] = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: (doc_id, n_tokens, p_0 .. p_k, rate, residual, converged).

    ``domains`` has (doc_id, domain from 0). Null and empty texts have no tokens and the priors as posterior; their
    rate follows from these. Repeated rows are documents of their own. If no rates meet the targets (a domain without
    documents, say) the rates are those of the least squares; ``residual`` and ``converged``, see ``Fit``, tell so in each row.
    """
    prepare(docs.sparkSession)
    mix = learn(docs, domains, key, text, len(targets))
    scored = with_posteriors(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__t")), mix, "__t").drop("__t")
    scored = saved(scored)
    found = fit(scored, targets)
    shares = [F.col(f"__p{i}").alias(f"p_{i}") for i in range(len(targets))]
    told = [rate(found.steps, len(targets)).alias("rate"), F.lit(found.residual).alias("residual"), F.lit(found.converged).alias("converged")]
    return scored.select("doc_id", F.col("__n").alias("n_tokens"), *shares, *told)


def mixed(docs: DataFrame, domains: DataFrame, targets: tuple[float, ...] = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more if a hash of its key is below the rest.

    The columns are those of ``docs``, whatever their names. Rows of one key fare alike; a null key counts as one key.
    """
    prepare(docs.sparkSession)
    mix = learn(docs, domains, key, text, len(targets))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # Written with the texts, which are scored once; the steps read the posteriors alone.
    scored = saved(with_posteriors(docs.select(*[named(c).alias(new) for c, new in names.items()]), mix, names[text]))
    found = fit(scored, targets)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(names[key])), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(rate(found.steps, len(targets)) + chance).cast("int")
    # The outer form, with its nulls left out afterwards: a filter on the times would be moved down and work the rates out twice.
    out = scored.withColumn("again", F.explode_outer(F.array_repeat(F.lit(0), times))).where("again is not null")
    return out.select(*[F.col(new).alias(c) for c, new in names.items()])
