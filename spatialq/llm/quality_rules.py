"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A document is kept if no rule rejects it. The rules' order never changes the verdict,
only what it costs: cost and rejection rate of each rule are measured on a random sample,
and the rules run by rejection per cost, highest first. A later rule is evaluated only on
documents that all earlier ones passed. A rule's cost is the time that further passes over
the sample add to a job, which leaves the job's own cost out.

Defined results: a null text has no words and fails; a very long text is measured whole,
in time that grows as its words times their logarithm; an empty table gives an empty
result (rules keep their listed order); repeated rows are judged alike; rules of equal
gain keep their listed order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body) -> Column:
    """Bind value once and use it many times inside body."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words inside a window of five words that the text holds twice or more.

    Windows are compared by 64-bit hash. Texts without an equal pair stop at the
    distinct count; the others sort (hash, place) pairs, mark equal neighbours and
    add up the places that marked windows cover. Linear but for that sort.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            hit = F.transform(
                s,
                lambda x, i: F.when(
                    (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
                    | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                    x["p"],
                ),
            )
            return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

        def total(pos: Column) -> Column:
            gaps = F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(let(pairs, marked), total)
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """A struct of the base measures of a text."""
    full = F.coalesce(text, F.lit(""))
    worded = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        n_lines = let(worded, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        return let(
            n_lines,
            lambda x: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                (F.char_length(full) - F.char_length(F.regexp_replace(full, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                x["d"].cast("bigint").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                x["n"].cast("bigint").alias("n_lines"),
            ),
        )

    return let(words(text), of)


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``fails`` is true; columns are those of ``measured``."""

    name: str
    fails: Column


def count_of(pattern: str) -> Column:
    return F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))


def default_rules() -> list[Rule]:
    """The production rules. Every limit sits far from ordinary prose of any length."""
    n = F.col("n_words")
    return [
        Rule("symbols", 5 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n)),
        Rule("dup_lines", (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("capitals", 2 * count_of(r"[A-Z]") > F.col("word_chars")),
        Rule("exclaims", 2 * count_of(r"!") > n),
        Rule("few_letters", 5 * count_of(r"\p{L}") < 2 * F.col("word_chars")),
        Rule("stutter", 5 * F.coalesce(F.regexp_count("text", F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")), F.lit(0)) > n),
    ]


def measured(docs: DataFrame) -> DataFrame:
    m = measures(F.col("text"))
    return (
        pick(docs, "doc_id", "text")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("m", m)
        .select("doc_id", "text", "m.*")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def pass_seconds(sample: DataFrame, rule: Rule, passes: int) -> tuple[float, int]:
    """Seconds of a job that evaluates the rule so many times on each row, and how many rows it rejects."""
    many = sample.withColumn("pass", F.explode(F.array_repeat(F.lit(1), passes)))
    began = time.perf_counter()
    rejected = many.agg(F.coalesce(F.sum(rule.fails.cast("int")), F.lit(0))).first()[0]
    return time.perf_counter() - began, rejected // passes


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 400, passes: int = 12) -> list[tuple[Rule, float, float]]:
    """Rules with seconds per row and rejection rate on a sample, best rejection per cost first.

    The sample is random, of about sample_rows rows, and settles the order of evaluation
    only; no verdict depends on it.
    """
    n = docs.count()
    drawn = docs.sample(fraction=min(1.0, sample_rows / n), seed=11) if n else docs
    sample = measured(drawn).filter("NOT base_failed").persist()
    try:
        total = sample.count()
        if not total:
            return [(r, 0.0, 0.0) for r in rules]
        found = []
        for r in rules:
            once, rejected = pass_seconds(sample, r, 1)
            more, _ = pass_seconds(sample, r, passes)
            cost = max((more - once) / ((passes - 1) * total), 1e-9)
            found.append((r, cost, rejected / total))
        return sorted(found, key=lambda x: -x[2] / x[1])
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base measures, the verdict and the first rule that rejected, for each row.

    CASE branches are evaluated in order and only until one holds, which is the
    short circuit.
    """
    order = [r for r, _, _ in ordered_rules(docs, rules if rules is not None else default_rules())]
    out = measured(docs)
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for r in order:
        reason = reason.when(r.fails, F.lit(r.name))
    return out.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("text")
