"""Mixing documents to target token shares by soft domain membership, with DataFrame functions only.

A multinomial naive Bayes classifier over hashed words is trained on the documents of a
labelled table, whose domain is known; it gives every document a posterior over domains.
Words are runs between blanks; in scripts written without blanks each letter is a word
of its own. The log likelihood of a text is scaled to that of at most ``EVIDENCE`` words,
which keeps memberships soft for long texts; every word of a text counts. Document rates
r >= ``low`` then minimise the squared distance between expected domain token totals,
sum of r * tokens * posterior, and the targets, in the norm given by the inverse of the
tokens' second moments S = sum of tokens * posterior * posterior'. The fit is projected
gradient descent: each step sums the totals over all documents, turns the residual into
one vector v = S^-1 (target - totals) over domains and sets r to max(low, r + posterior . v).
With a document's step divided by its tokens the curvature of that objective is 1, so a
full step never overshoots. A rate is thus a short chain of expressions over the
posterior; only totals, one number for each pair of domains, and the classifier's word
counts, BUCKETS numbers a domain, reach the driver.

Defined results: a null or empty text has no tokens and the prior as its posterior; a very
long text is scored whole; documents with a null domain are scored but teach nothing;
targets of domains that no labelled document has are left out and the others share their
weight; without any labelled document all rates are 1 (or ``low``, if larger); repeated
rows have equal rates, and ties of the likeliest domain go to the first by name; an
empty table gives an empty result. In ``mixed`` other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written

MAX_DOMAINS = 64
BUCKETS = 4096
EVIDENCE = 12.0
#: Code points of the main scripts that are written without blanks.
UNSPACED = r"[\u0E00-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\x{1B000}-\x{3FFFF}]"


def word_buckets(text: Column) -> Column:
    """The hash bucket of each word of a text."""
    full = F.coalesce(text, F.lit(""))
    spaced = F.when(full.rlike(UNSPACED), F.regexp_replace(full, f"({UNSPACED})", " $1 ")).otherwise(full)
    found = F.filter(F.split(spaced, r"\s"), lambda w: w != "")
    return F.transform(found, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def numbers(values: Iterable[float]) -> Column:
    """A constant array; the optimizer folds the text into one literal."""
    return F.split(F.lit(",".join(f"{x:.5f}" for x in values)), ",").cast("array<double>")


@dataclass(frozen=True)
class Classifier:
    """Domains in ascending order, their log priors, and each domain's log share of every bucket."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    weights: np.ndarray

    def posterior(self, df: DataFrame, buckets: str) -> DataFrame:
        """df with p0, p1, ... in place of its column of buckets."""
        k = len(self.domains)
        if not k:
            return df.drop(buckets)
        scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(buckets), F.lit(1)))

        def total(ws: np.ndarray) -> Column:
            table = numbers(ws)
            return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))

        out = df.withColumns({f"l{i}": F.lit(p) + scale * total(ws) for i, (p, ws) in enumerate(zip(self.priors, self.weights, strict=True))})
        top = F.greatest(*(f"l{i}" for i in range(k))) if k > 1 else F.col("l0")
        out = out.drop(buckets).withColumn("top", top).withColumns({f"e{i}": F.exp(F.col(f"l{i}") - F.col("top")) for i in range(k)})
        out = out.withColumn("whole", sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0")))
        out = out.withColumns({f"p{i}": F.col(f"e{i}") / F.col("whole") for i in range(k)})
        return out.drop("top", "whole", *(f"{c}{i}" for c in "le" for i in range(k)))


def train(docs: DataFrame, labels: DataFrame, domain: str, max_train: int = 20_000) -> Classifier:
    """Naive Bayes from word counts by domain over at most max_train labelled documents.

    Which ones is settled by a hash of doc_id over all of them. Counts are summed before
    anything is gathered.
    """
    ids = pick(docs, "doc_id", domain).toDF("doc_id", "domain").filter("domain IS NOT NULL")
    ids = ids.join(pick(labels, "doc_id").distinct(), "doc_id", "left_semi")
    chosen = written(ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "chosen")
    known = pick(docs, "doc_id", "text", domain).toDF("doc_id", "text", "domain").join(chosen, "doc_id", "left_semi").filter("domain IS NOT NULL")
    rows = known.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    at = {r["domain"]: i for i, r in enumerate(rows)}
    counts = np.ones((len(rows), BUCKETS))
    # outer: else the optimizer adds a filter that cuts each text into words once more
    words = known.select("domain", F.explode_outer(word_buckets(F.col("text"))).alias("b")).filter("b IS NOT NULL")
    for r in words.groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        counts[at[r["domain"]], r["b"]] += r["n"]
    all_rows = sum(r["n"] for r in rows)
    return Classifier(tuple(at), tuple(math.log(r["n"] / all_rows) for r in rows), np.log(counts / counts.sum(axis=1, keepdims=True)))


def rate_of(steps: list[list[float]], start: float, low: float, p: list[Column]) -> Column:
    """The rate after the given projected steps, as an expression over the posterior."""
    r = F.lit(start)
    for v in steps:
        r = F.greatest(F.lit(low), r + sum((F.lit(float(x)) * q for x, q in zip(v[1:], p[1:], strict=True)), F.lit(float(v[0])) * p[0]))
    return r


@dataclass(frozen=True)
class Mix:
    model: Classifier
    steps: list[list[float]]
    start: float
    low: float
    targets: list[float]
    totals: list[float]

    def rate_at(self, p: list[Column]) -> Column:
        return rate_of(self.steps, self.start, self.low, p)

    def rate(self) -> Column:
        """The rate over columns p0, p1, ..."""
        if not self.model.domains:
            return F.lit(max(1.0, self.low))
        return self.rate_at([F.col(f"p{i}") for i in range(len(self.model.domains))])


def shares(model: Classifier, weights: dict[str, float]) -> np.ndarray:
    w = np.array([max(0.0, float(weights.get(d, 0.0))) for d in model.domains])
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1.0 / max(1, len(w)))


def fit(members: DataFrame, model: Classifier, weights: dict[str, float], budget: float | None = None, low: float = 0.0, rounds: int = 25, tolerance: float = 1e-4) -> Mix:
    """Rates whose expected domain totals meet the weights' shares of the budget.

    budget: tokens in the mixture; None keeps the corpus's tokens, or, if rates may not
    fall below ``low`` > 0, takes the least budget that leaves each domain that rate.
    """
    k = len(model.domains)
    if not k:
        return Mix(model, [], max(1.0, low), low, [], [])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = members.agg(
        *(F.coalesce(F.sum(F.col("t") * F.col(f"p{i}")), F.lit(0.0)).alias(f"m{i}") for i in range(k)),
        *(F.coalesce(F.sum(F.col("t") * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs),
    ).first()
    have = np.array([got[f"m{i}"] for i in range(k)])
    share = shares(model, weights)
    if budget is None:
        budget = have.sum()
        if low > 0:
            budget = max([budget, *(low * h / s for h, s in zip(have, share, strict=True) if s > 0)])
    target = share * budget
    second = np.zeros((k, k))
    for i, j in pairs:
        second[i, j] = second[j, i] = got[f"s{i}_{j}"]
    second += np.eye(k) * max(second.trace() * 1e-9, 1e-12)
    start = max(1.0, low)
    steps: list[list[float]] = []
    totals = have * start
    for _ in range(rounds):
        if np.abs(target - totals).max() <= tolerance * max(budget, 1.0):
            break
        step = np.linalg.solve(second, target - totals)
        steps.append(step.tolist())
        r = rate_of(steps, start, low, [F.col(f"p{i}") for i in range(k)])
        row = members.agg(*(F.coalesce(F.sum(F.col("t") * r * F.col(f"p{i}")), F.lit(0.0)).alias(f"m{i}") for i in range(k))).first()
        new = np.array([row[f"m{i}"] for i in range(k)])
        if np.abs(new - totals).max() <= 1e-3 * tolerance * max(budget, 1.0):
            totals = new
            break
        totals = new
    return Mix(model, steps, start, low, target.tolist(), totals.tolist())


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the key's md5."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies: the rate rounded down, and one more with the probability of its fraction."""
    return (F.floor(rate) + F.when(unit_hash(key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


BINS = "buckets"


def counted(docs: DataFrame, text: str) -> DataFrame:
    """docs with the buckets of its words and their number ``t``."""
    return docs.withColumn(BINS, word_buckets(F.col(text))).withColumn("t", F.size(BINS).cast("double"))


def mix_table(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = "lang", budget: float | None = None, low: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posteriors, rate and copies of every document."""
    model = train(docs, labels, domain)
    members = written(model.posterior(counted(pick(docs, "doc_id", "text"), "text").drop("text"), BINS), "members")
    mix = fit(members, model, weights, budget, low)
    k = len(model.domains)
    post = F.array(*(F.col(f"p{i}") for i in range(k))) if k else F.array().cast("array<double>")
    likely = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position(post, F.array_max(post)).cast("int")) if k else F.lit(None).cast("string")
    return members.withColumn("rate", mix.rate()).select(
        "doc_id", F.col("t").cast("bigint").alias("n_tokens"), likely.alias("domain"), post.alias("posteriors"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies")
    )


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = "lang", budget: float | None = None, low: float = 0.0) -> DataFrame:
    """docs with each row as often as its copies say; the columns stay as they are.

    Rows are written once with their posteriors beside them; the fit reads those columns
    alone, the result the rest, so no text is scored twice and no row needs a key.
    """
    model = train(docs, labels, domain)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    text, key = (inner[docs.columns.index(c)] for c in ("text", "doc_id"))
    scored = written(model.posterior(counted(docs.toDF(*inner), text), BINS), "members")
    mix = fit(scored, model, weights, budget, low)
    n = copies(F.col("rate"), F.col(key))
    repeated = scored.withColumn("rate", mix.rate()).withColumn("copy", F.explode(F.array_repeat(F.lit(1), n)))
    return repeated.select(*inner).toDF(*docs.columns)
