"""Document rates that mix soft domains to target token weights; DataFrame functions only.

A naive Bayes classifier over hashed words learns the domain of documents that the labelled table
covers (at most TRAIN_ROWS of them, by a hash of the id) and gives every document a
posterior over the domains.  With n_i words and posterior p_i, rates r_i >= 0 minimise the squared
relative errors of the expected domain totals sum_i r_i n_i p_i against the targets, by projected
gradient steps from r = 1: each step is one distributed sum of a number for each domain, and a
column expression for every document.  Scaled by the domains' shares the problem has a Lipschitz
constant of 1, so a step of 1 is safe.  Steps go on until every total is within TOLERANCE of its
target or no longer moves; a warning tells if STEPS of them were not enough.  Tokens are
blank-separated words.

The total asked for is the least that keeps the most plentiful domain, measured by its target
weight, at about its present size: scarce domains are repeated and no domain is cut.  A document is
then repeated floor(rate) times and once more by a hash of its id against the fraction.

The query's domains are the languages of `lang`: a source of these tables says nothing of its text.

Defined results: rows that share a doc_id are one document (words add up, one rate); text null or
blank has the prior as posterior and no words; without labelled rows, or with one domain, every
rate is 1; a null domain is learnt from nothing but has a posterior; targets name learnt domains, a
domain without a target has weight 0; with words in no targeted domain every rate stays 1; further
columns pass through `mixed_documents` whatever their names.  A very long text is one row's array of
words, so a task holds a few times its bytes.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import discard, free_names, hash_sample, materialise

TRAIN_ROWS = 4000
BUCKETS = 4096
STEPS, WRITE_EVERY, TOLERANCE = 600, 6, 1e-7
#: Without given targets, weights are shares to this power, normalised.
FLATTEN = 0.7


def _words(documents: DataFrame) -> DataFrame:
    """(doc_id, ..., b): a row for each word with its bucket; null for a document without words."""
    plain = F.lower(F.coalesce("text", F.lit("")))
    for blank in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    parts = F.explode_outer(F.split(plain, " "))
    rest = [c for c in documents.columns if c != "text"]
    rows = documents.select(*rest, parts.alias("w"))
    return rows.select(*rest, F.when(F.col("w") != "", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).alias("b"))


def classifier(documents: DataFrame, labelled: DataFrame, domain: str) -> tuple[list[str], list[float], DataFrame | None]:
    """Domains, their shares of labelled documents, and (b, l0, l1, ...): log likelihoods of BUCKETS rows."""
    ids = labelled.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = hash_sample(ids, ids.count(), TRAIN_ROWS, "_id")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(domain).cast("string").alias("domain")).where("domain is not null")
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")  # at most TRAIN_ROWS ids
    rows = materialise(rows, "labelled")
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if len(names) < 2:
        return names, [1.0] * len(names), None
    words = _words(rows.select("doc_id", "domain", "text")).where("b is not null")
    seen = words.groupBy("b").agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"c{i}") for i, d in enumerate(names)])
    total = seen.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(len(names))]).collect()[0]
    every = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    table = every.join(seen, "b", "left").select(
        "b", *[F.log((F.coalesce(F.col(f"c{i}"), F.lit(0.0)) + 1) / (total[i] + BUCKETS)).alias(f"l{i}") for i in range(len(names))]
    )
    size = sum(counts.values())
    return names, [counts[n] / size for n in names], materialise(table, "classifier")


def posteriors(documents: DataFrame, names: list[str], prior: list[float], table: DataFrame | None) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ...: a row for each doc_id."""
    words = _words(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if table is None:
        rows = words.groupBy("doc_id").agg(F.count("b").alias("n_tokens"))
        return rows.select("doc_id", "n_tokens", *[F.lit(1.0).alias(f"p{i}") for i in range(len(names))])
    every = range(len(names))
    scored = words.join(F.broadcast(table), "b", "left")  # BUCKETS rows
    sums = scored.groupBy("doc_id").agg(F.count("b").alias("n_tokens"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"s{i}") for i in every])
    logs = [F.col(f"s{i}") + F.log(F.lit(prior[i])) for i in every]
    sums = sums.select("doc_id", "n_tokens", *[x.alias(f"g{i}") for i, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"g{i}") for i in every])
    parts = [F.exp(F.col(f"g{i}") - top) for i in every]
    whole = reduce(Column.__add__, parts)
    return sums.select("doc_id", "n_tokens", *[(p / whole).alias(f"p{i}") for i, p in enumerate(parts)])


def _totals(rows: DataFrame, rate: Column, count: int) -> list[float]:
    got = rows.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"a{i}") for i in range(count)]).collect()[0]
    return [float(x) for x in got]


def _targets(totals: list[float], names: list[str], weights: Mapping[str, float] | None) -> list[float]:
    size = sum(totals)
    if weights is None:
        raw = [(t / size) ** FLATTEN if t > 0 else 0.0 for t in totals]
    else:
        raw = [float(weights.get(n, 0.0)) if t > 0 else 0.0 for n, t in zip(names, totals, strict=True)]
    whole = sum(raw)
    if not whole:
        return totals
    share = [r / whole for r in raw]
    budget = max(t / s for t, s in zip(totals, share, strict=True) if s > 0)
    return [s * budget for s in share]


class _Gap:
    """Watches the greatest relative error of the totals: small enough, or the same for ten steps."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance, self.last, self.still = tolerance, float("inf"), 0

    def closed(self, now: float) -> bool:
        self.still = self.still + 1 if now > self.last * (1 - 1e-6) else 0
        self.last = min(now, self.last)
        return now < self.tolerance or self.still >= 10


def mix(documents: DataFrame, labelled: DataFrame, domain: str = "lang", weights: Mapping[str, float] | None = None) -> tuple[DataFrame, list[str], list[float]]:
    """(doc_id, n_tokens, p0, ..., rate, copies), the domains, and the targets of their tokens."""
    names, prior, table = classifier(documents, labelled, domain)
    rows = posteriors(documents, names, prior, table).withColumn("rate", F.lit(1.0))
    rows = rows_written = materialise(rows, "rates")
    targets: list[float] = []
    if len(names) > 1:
        every = range(len(names))
        totals = _totals(rows, F.lit(1.0), len(names))
        size = sum(totals)
        if size > 0:
            targets = _targets(totals, names, weights)
            share = [max(t / size, 1e-12) for t in totals]
            gap = _Gap(TOLERANCE)
            for step in range(STEPS + 1):
                error = [(a - t) / size for a, t in zip(_totals(rows, F.col("rate"), len(names)), targets, strict=True)]
                if gap.closed(max(abs(e) / s for e, s in zip(error, share, strict=True))):
                    break
                if step == STEPS:
                    warnings.warn(f"after {STEPS} steps domain totals are up to {gap.last:.2g} of a domain's share off their targets", stacklevel=2)
                    break
                move = reduce(Column.__add__, [F.col(f"p{i}") * (error[i] / share[i]) for i in every])
                rows = rows.withColumn("rate", F.greatest(F.col("rate") - move, F.lit(0.0)))
                if step % WRITE_EVERY == WRITE_EVERY - 1:
                    rows, before = materialise(rows, "rates"), rows_written
                    discard(before)
                    rows_written = rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    # a rate within a thousandth of a whole number is that number: the solver leaves such errors
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-3, F.round("rate")).otherwise(F.col("rate"))
    copies = F.floor(near) + (part < near - F.floor(near)).cast("long")
    return rows.withColumn("copies", copies.cast("long")), names, targets


def mixed_domains(documents: DataFrame, labelled: DataFrame, domain: str = "lang", weights: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior (of it), rate, copies."""
    rows, names, _ = mix(documents, labelled, domain, weights)
    if not names:
        return rows.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), "rate", "copies")
    top = F.greatest(*[F.col(f"p{i}") for i in range(len(names))]) if len(names) > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(f"p{i}") == top, F.lit(n)) for i, n in enumerate(names)])
    return rows.select("doc_id", "n_tokens", name.alias("domain"), top.alias("posterior"), "rate", "copies")


def mixed_documents(documents: DataFrame, labelled: DataFrame, domain: str = "lang", weights: Mapping[str, float] | None = None) -> DataFrame:
    """The documents, each repeated as often as its copies say."""
    rows, *_ = mix(documents, labelled, domain, weights)
    key, count, copy = free_names(documents, "_id", "_count", "_copy")
    copies = rows.where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").cast("int").alias(count))
    joined = documents.join(copies, documents.doc_id.eqNullSafe(F.col(key)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(count)))).select(*documents.columns)
