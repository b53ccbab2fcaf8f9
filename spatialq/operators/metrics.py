"""Losses of predictions and permutation p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_average_rank

CORRELATIONS = ("pearson", "spearman")


def nll_of_mse(mse: Column, n: Column) -> Column:
    return n / 2 * F.log(F.lit(2 * math.pi) * mse + 1e-12) + n / 2


def losses(df: DataFrame, keys: list[str]) -> DataFrame:
    """MSE and Gaussian NLL of rows (value, predicted), by keys."""
    a = df.groupBy(*keys).agg(F.avg((F.col("predicted") - F.col("value")) * (F.col("predicted") - F.col("value"))).alias("mse"), F.count("*").alias("_n"))
    return a.withColumn("nll_gaussian", nll_of_mse(F.col("mse"), F.col("_n"))).drop("_n")


def masked_losses(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Losses over the masked cells only; a key without any is an error at use."""
    on = df.join(mask.select(*mask.columns, F.lit(True).alias("_on")).distinct(), mask.columns, "left")
    seen = on.groupBy(*keys).agg(F.count("_on").alias("_n"))
    empty = seen.withColumn("_n", F.when(F.col("_n") == 0, F.raise_error(F.lit("an empty mask"))).otherwise(F.col("_n"))).filter("_n > 0")
    found = losses(on.filter("_on"), keys)
    return (empty.join(found, keys, "left") if keys else empty.crossJoin(F.broadcast(found))).drop("_n")


def nll_poisson(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of factor * exp(eta) - value * eta over rows (value, eta, factor)."""
    return df.groupBy(*keys).agg(F.avg(F.col("factor") * F.exp("eta") - F.col("value") * F.col("eta")).alias("nll_poisson"))


def correlation(df: DataFrame, keys: list[str], inner: str = "gene", a: str = "value", b: str = "predicted") -> DataFrame:
    """Mean over ``inner`` of the correlation by keys; a flat side counts as 0."""
    each = df.groupBy(*keys, inner).agg(pearson(a, b).alias("r"))
    return each.groupBy(*keys).agg(F.avg("r").alias("r"))


def pearson(a: str, b: str) -> Column:
    """Correlation with 0 where a side has no variance."""
    flat = (F.var_pop(a) * F.var_pop(b)) <= 1e-24
    return F.when(flat, 0.0).otherwise(F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b)))


def rank_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with its columns replaced by their mean ranks within keys."""
    for c in columns:
        df = with_average_rank(df, c, keys, "_rank").drop(c).withColumnRenamed("_rank", c)
    return df


def permutation_p(stats: DataFrame, keys: list[str], higher_is_better: bool = False) -> DataFrame:
    """(keys, stat_true, p_value, n_perms) from rows (slot, stat): slot 0 is the truth.

    p = (1 + nulls at least as good as the truth) / (n + 1).
    """
    truth = stats.filter("slot = 0").select(*keys, F.col("stat").alias("stat_true"))
    nulls = stats.filter("slot > 0")
    both = nulls.join(truth, keys) if keys else nulls.crossJoin(F.broadcast(truth))
    good = F.col("stat") >= F.col("stat_true") if higher_is_better else F.col("stat") <= F.col("stat_true")
    return both.groupBy(*keys, "stat_true").agg(((F.count_if(good) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n_perms"))


def minmax(value: Column, lo: Column, hi: Column) -> Column:
    return (value - lo) / (hi - lo + 1e-8)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median")
    )
