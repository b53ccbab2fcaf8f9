"""What filters remove together: every order of applying them, and each one's Shapley share.

A document fails some of k filters. Only the number of documents by set of failed filters
matters for all else, so that one pass over the texts and one count give the removals
v(S) of all 2^k coalitions S of filters: the documents that fail a member of S.

The Hart-Mas-Colell potential P of that game is built coalition by coalition from smaller
ones: P(S) = (v(S) + sum over i in S of P(S less i)) / |S|, and filter i's Shapley value is
P(all) - P(all less i). Potentials are held as whole numbers, times the least common
multiple of 1..k. A step of an order is a difference of two coalitions.

Duplicates are found table-wide by the SHA-256 of the texts: rows of equal texts are first
counted by part, so a text that fills a third of the table is a few rows when its copies meet.

Defined results: a null text is the empty text, a null source the part ""; a null doc_id
has no labels, is no copy of anything and makes nothing else a copy; repeated rows count
each, and rows of one doc_id are no copies of each other; a document is good (toxic) if any
of its labels says 1; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .quality_rules import let, words


def failed_filters(text: Column) -> Column:
    """Filters A to D of a whole text as the bits 1, 2, 4 and 8 of an int."""

    def bit(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    def of(w: Column) -> Column:
        n = F.size(w)
        return bit(n < 50, 1) + bit(100 * F.size(F.array_distinct(w)) < 65 * n, 2)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return let(words(text), of) + bit(100 * capitals > 5 * F.length(text), 4) + bit(text.rlike(r"[#$%&*|]"), 8)


def failure_counts(docs: DataFrame, labels: DataFrame, own: Callable[[Column], Column] = failed_filters, copy_bit: int = 16) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters that they fail.

    own: the filters that see one text only; copy_bit marks texts that a smaller doc_id has.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text", "source").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), own(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h")
    )
    marks = pick(labels, "doc_id", "quality", "toxic").filter(F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["part", "mask", "good", "toxic"]
    ids = known.groupBy("doc_id", "h", *kind).agg(F.count("*").alias("c"))
    texts = ids.groupBy("h", *kind).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("low"),
        F.min_by("c", "doc_id").alias("at_low"),
    )
    first = texts.groupBy("h").agg(F.min("low").alias("first"))
    originals = F.col("nameless") + F.when(F.col("low") == F.col("first"), F.col("at_low")).otherwise(0)
    both = texts.join(first, "h").groupBy(*kind).agg(F.sum(originals).alias("o"), F.sum(F.col("n") - originals).alias("d"))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("o").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), F.col("d").alias("n")))
    return both.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "good", "toxic", "s.n").filter("n > 0")


def coalition_values(counts: DataFrame, k: int) -> DataFrame:
    """(part, n, v, vg, vt): documents, and those, the good and the toxic ones that coalition S removes, at place S of an array."""
    each = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))))
    hit = F.when(F.col("mask").bitwiseAND(F.col("s")) != 0, F.col("n")).otherwise(0)
    sums = each.groupBy("part", "s").agg(
        F.sum("n").alias("n"), F.sum(hit).alias("v"), F.sum(F.when(F.col("good"), hit).otherwise(0)).alias("vg"), F.sum(F.when(F.col("toxic"), hit).otherwise(0)).alias("vt")
    )
    rows = sums.groupBy("part").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("s", "v", "vg", "vt"))).alias("r"))  # 2^k entries
    return rows.select("part", "n", *(F.col(f"r.{c}").alias(c) for c in ("v", "vg", "vt")))


def potentials(v: Column, k: int) -> Column:
    """The potential of every coalition, times lcm(1..k), from the array of their values."""
    scale = math.lcm(*range(1, k + 1))

    def grown(p: Column, s: Column) -> Column:
        less = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - (1 << i))).otherwise(F.lit(0).cast("bigint")) for i in range(k)]
        total = F.get(v, s) * scale
        for x in less:
            total = total + x
        return F.concat(p, F.array(F.call_function("div", total, F.bit_count(s).cast("bigint"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2**k - 1)), F.array(F.lit(0).cast("bigint")), grown)


def audit(docs: DataFrame, labels: DataFrame, names: str = "ABCDE", own: Callable[[Column], Column] = failed_filters) -> DataFrame:
    """One row a part, order of the filters and step, with counts, and the filter's Shapley value times k!.

    names: a letter for each bit of ``own``, from the lowest, then one for copies.
    """
    k = len(names)
    values = coalition_values(failure_counts(docs, labels, own, 1 << (k - 1)), k).withColumn("p", potentials(F.col("v"), k))
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(names))), ",")  # k! short strings
    rows = values.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def coalition(letters: Column) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1), F.position(c, F.lit(names)) - 1)
        return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + bit(c))

    order, step = F.col("filter_order"), F.col("step")
    rows = rows.withColumn("before", coalition(F.substring(order, F.lit(1), step - 1))).withColumn("bit", coalition(F.substring(order, step, F.lit(1))))
    after, all_, before = F.col("before") + F.col("bit"), F.lit(2**k - 1), F.col("before")

    def gain(c: str) -> Column:
        return F.get(c, after) - F.get(c, before)

    scale = math.factorial(k) // math.lcm(*range(1, k + 1))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.get("v", after)).alias("kept"),
        gain("v").alias("removed"),
        (F.get("v", F.col("bit")) - gain("v")).alias("redundant"),
        (F.get("v", all_) - F.get("v", all_ - F.col("bit"))).alias("unique_fails"),
        gain("vg").alias("good_lost"),
        gain("vt").alias("toxic_lost"),
        ((F.get("p", all_) - F.get("p", all_ - F.col("bit"))) * scale).alias("shapley"),
    )
