"""Preranked gene-set enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import order_key
from .ranks import bh_qvalues


def running_sums(ranking: DataFrame, sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pathway, gene, rank, hit, run) over ranking(keys, gene, score), best score first.

    Hits step up by their share of absolute scores, misses down evenly.
    """
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "gene")
    ranked = ranking.select(*keys, "gene", F.abs("score").alias("w"), F.row_number().over(order).alias("rank"))
    hits = sets.select("pathway", "gene", F.lit(True).alias("hit"))
    each = ranked.crossJoin(F.broadcast(sets.select("pathway").distinct())).join(F.broadcast(hits), ["pathway", "gene"], "left")
    each = each.withColumn("hit", F.coalesce("hit", F.lit(False)))
    whole = Window.partitionBy(*keys, "pathway")
    up = F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).over(whole)
    down = F.sum((~F.col("hit")).cast("int")).over(whole)
    step = F.when(F.col("hit"), F.try_divide(F.col("w"), up)).otherwise(F.try_divide(F.lit(-1.0), down))
    return each.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("run", F.sum("_s").over(whole.orderBy("rank")))


def enrichment(ranking: DataFrame, sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pathway, size, es): the extreme of larger size, the maximum on ties."""
    run = running_sums(ranking, sets, keys)
    hi, lo = F.max("run"), F.min("run")
    return run.groupBy(*keys, "pathway").agg(F.sum(F.col("hit").cast("int")).alias("size"), F.when(hi >= -lo, hi).otherwise(lo).alias("es"))


def leading_edge(ranking: DataFrame, sets: DataFrame) -> DataFrame:
    """(pathway, gene, rank): a set's genes up to the peak of its running sum, or from the trough on where that is larger."""
    run = running_sums(ranking, sets)
    ends = run.groupBy("pathway").agg(F.max("run").alias("hi"), F.min("run").alias("lo"), F.min_by("rank", F.struct(-F.round("run", 12), "rank")).alias("top"), F.min_by("rank", F.struct(F.round("run", 12), "rank")).alias("low"))
    up = F.col("hi") >= -F.col("lo")
    return run.filter("hit").join(ends, "pathway").filter(F.when(up, F.col("rank") <= F.col("top")).otherwise(F.col("rank") >= F.col("low"))).select("pathway", "gene", "rank")


def preranked(ranking: DataFrame, sets: DataFrame, n_perms: int, seed: int, least: int = 3, most: int = 500) -> DataFrame:
    """pathway, size, es, nes, p_value, q_value from permutations of the gene labels.

    nes divides by the mean of nulls of the same sign; p counts nulls of that sign at
    least as extreme, plus one.
    """
    true = enrichment(ranking, sets).filter(F.col("size").between(least, most))
    many = ranking.select("gene", "score").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n_perms))))
    own = many.withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy("gene")))
    deal = many.select("slot", "gene").withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy(order_key(seed, "slot", "gene"), "gene")))
    shuffled = own.drop("gene").join(deal, ["slot", "_r"]).select("slot", "gene", "score")
    nulls = enrichment(shuffled, sets, ("slot",)).select("pathway", F.col("es").alias("e0"))
    both = true.join(nulls, "pathway")
    same = (F.col("es") >= 0) == (F.col("e0") >= 0)
    out = both.groupBy("pathway", "size", "es").agg(
        F.avg(F.when(same, F.abs("e0"))).alias("_m"),
        ((F.count_if(same & (F.abs("e0") >= F.abs("es"))) + 1) / (F.count_if(same) + 1)).alias("p_value"),
    )
    return bh_qvalues(out.select("pathway", "size", "es", F.try_divide("es", "_m").alias("nes"), "p_value"))
