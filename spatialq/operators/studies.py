"""Grids of study conditions and roll-ups of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import order_key
from ..sources.scratch import written


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values, one column an axis."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def rates(rows: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """n, n_reject (p < alpha), rate, se and a 95 % interval clipped to [0, 1]."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("p_value") < alpha).alias("n_reject"))
    a = a.withColumn("rate", F.col("n_reject") / F.col("n")).withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))
    return a.withColumn("lo", F.greatest(F.lit(0.0), F.col("rate") - 1.96 * F.col("se"))).withColumn("hi", F.least(F.lit(1.0), F.col("rate") + 1.96 * F.col("se")))


def p_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg("p_value").alias("mean_p"), F.stddev_pop("p_value").alias("std_p"), F.min("p_value").alias("min_p"), F.max("p_value").alias("max_p"), F.avg("stat").alias("mean_stat")
    )


def kernel_summary(rows: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Rejections with p <= alpha, median and mean p."""
    hit = F.count_if(F.col("p_value") <= alpha)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), hit.alias("n_reject"), (hit / F.count("*")).alias("rate"), F.percentile("p_value", F.lit(0.5)).alias("median_p"), F.avg("p_value").alias("mean_p"))


def weighted_loss(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Fold losses weighted by fold sizes."""
    return folds.groupBy(*keys).agg((F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias("loss"))


def best_of_k(losses: DataFrame, ks: list[int], draws: int, seed: int) -> DataFrame:
    """(k, mean, std, p5, p95) of the least of k of the losses drawn without replacement.

    Only keys below a limit are sorted: it leaves some times the losses that are needed, and is
    raised if a draw has too few.
    """
    n, most = losses.count(), max(ks)
    keyed = losses.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", order_key(seed, "draw", "run_id"))
    share = 16 * most / n if n else 1.0
    while True:
        d = keyed if share >= 0.5 else keyed.filter(F.col("_h") < f"{int(share * 2**32):08x}")
        d = written(d, "draws")
        if share >= 0.5 or (d.groupBy("draw").count().filter(F.col("count") >= most).count() == draws):
            break
        share *= 8
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy("_h", "run_id"))).filter(F.col("_r") <= most)
    m = d.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("_r <= k").groupBy("k", "draw").agg(F.min("stat").alias("b"))
    return m.groupBy("k").agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("std"), F.percentile("b", F.lit(0.05)).alias("p5"), F.percentile("b", F.lit(0.95)).alias("p95"))


def with_status(manifest: DataFrame, results: DataFrame, keys: list[str], value: str) -> DataFrame:
    return manifest.join(results, keys, "left").withColumn("status", F.when(F.col(value).isNull(), "MISSING").otherwise("ok"))


def first_of(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second whose keys first lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def p_trajectory(losses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch, p_value) from losses(keys, slot, rerun, epoch, loss)."""
    last = losses.groupBy(*keys, "slot").agg(F.max("epoch").alias("last"))
    final = losses.join(last, [*keys, "slot"]).filter("epoch = last").groupBy(*keys, "slot").agg(F.min_by("rerun", F.struct("loss", "rerun")).alias("rerun"))
    best = losses.join(final, [*keys, "slot", "rerun"])
    truth = best.filter("slot = 0").select(*keys, "epoch", F.col("loss").alias("_t"))
    both = best.filter("slot > 0").join(truth, [*keys, "epoch"])
    return both.groupBy(*keys, "epoch").agg(((F.count_if(F.col("loss") <= F.col("_t")) + 1) / (F.count("*") + 1)).alias("p_value"))
