"""Closed-form decoders from sufficient statistics, F statistics, and iterated Poisson fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_tail
from ..sources.scratch import written
from .ranks import lower_median


def depth_axis(slots: DataFrame) -> DataFrame:
    """(slot, cell_id, z): distance from the lower-median vertical midline of each slot."""
    mid = lower_median(slots, "slot", "x").withColumnRenamed("median", "_m")
    return slots.join(F.broadcast(mid), "slot").select("slot", "cell_id", F.abs(F.col("x") - F.col("_m")).alias("z"))


def linear_sums(df: DataFrame, keys: list[str], z: str = "z", y: str = "value") -> DataFrame:
    """Sums that determine the least squares fit of y on (z, 1), by keys."""
    a, b = F.col(z), F.col(y)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(a).alias("sz"), F.sum(b).alias("sy"), F.sum(a * a).alias("szz"), F.sum(a * b).alias("szy"), F.sum(b * b).alias("syy")
    )


def linear_fit(sums: DataFrame) -> DataFrame:
    """slope, intercept, sst and sse from linear_sums; a flat z has slope 0."""
    n = F.col("n").cast("double")
    vz = F.col("szz") - F.col("sz") * F.col("sz") / n
    c = F.col("szy") - F.col("sz") * F.col("sy") / n
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    slope = F.when(vz > 1e-12, c / F.when(vz > 1e-12, vz)).otherwise(0.0)
    out = sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sz")) / n)
    return out.withColumn("sst", F.greatest(sst, F.lit(0.0))).withColumn("sse", F.greatest(sst - F.col("slope") * c, F.lit(0.0)))


def quadratic_fit(df: DataFrame, keys: list[str], z: str = "z", y: str = "value") -> DataFrame:
    """b2, b1, b0, sst and sse of the fit on (z, z^2, 1): Cramer's rule on centred moments."""
    a, b = F.col(z), F.col(y)
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("mz"), F.avg(a * a).alias("m2"), F.avg(b).alias("my"),
        F.avg(a * a * a).alias("m3"), F.avg(a * a * a * a).alias("m4"), F.avg(a * b).alias("mzy"), F.avg(a * a * b).alias("m2y"), F.avg(b * b).alias("myy"),
    )
    s11, s12, s22 = F.col("m2") - F.col("mz") * F.col("mz"), F.col("m3") - F.col("mz") * F.col("m2"), F.col("m4") - F.col("m2") * F.col("m2")
    t1, t2 = F.col("mzy") - F.col("mz") * F.col("my"), F.col("m2y") - F.col("m2") * F.col("my")
    det = s11 * s22 - s12 * s12
    ok = F.when(F.abs(det) > 1e-18, det)
    b1, b2 = F.coalesce((t1 * s22 - t2 * s12) / ok, F.lit(0.0)), F.coalesce((t2 * s11 - t1 * s12) / ok, F.lit(0.0))
    out = s.withColumn("b1", b1).withColumn("b2", b2).withColumn("t1", t1).withColumn("t2", t2)
    sst = F.col("n") * (F.col("myy") - F.col("my") * F.col("my"))
    sse = sst - F.col("n") * (F.col("b1") * F.col("t1") + F.col("b2") * F.col("t2"))
    return out.select(
        *keys, "n", "b2", "b1", (F.col("my") - F.col("b1") * F.col("mz") - F.col("b2") * F.col("m2")).alias("b0"),
        F.greatest(sst, F.lit(0.0)).alias("sst"), F.greatest(sse, F.lit(0.0)).alias("sse"),
    )


def f_statistic(sst: Column, sse: Column, n: Column, df_model: int) -> Column:
    """F of a model with df_model terms; null where there are no error degrees of freedom or no variance."""
    ssr = F.greatest(sst - sse, F.lit(0.0))
    df_error = n - df_model - 1
    ok = (df_error > 0) & (sst > 1e-12) & (sse > 0)
    return F.when(ok, (ssr / df_model) / (F.when(ok, sse) / df_error))


def with_f_p(fits: DataFrame, df_model: int) -> DataFrame:
    """fits with f_stat and p_value (1 where F is undefined)."""
    stat = f_statistic(F.col("sst"), F.col("sse"), F.col("n"), df_model)
    out = fits.withColumn("f_stat", stat)

    @F.pandas_udf("double")
    def tail(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(f_tail(f.to_numpy(float), df_model, n.to_numpy(float) - df_model - 1))

    return out.withColumn("p_value", F.coalesce(F.nanvl(tail("f_stat", "n"), F.lit(1.0)), F.lit(1.0)))


def poisson_fit(y: np.ndarray, x: np.ndarray, log_exposure: np.ndarray, degree: int = 1, rounds: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Coefficients (intercept first, of powers of the standardised x) by iterated weighted least squares."""
    if y.sum() <= 0:
        return np.array([-20.0] + [0.0] * degree)
    z = (x - x.mean()) / max(x.std(), 1e-12)
    design = np.stack([z**k for k in range(degree + 1)], 1)
    beta = np.zeros(degree + 1)
    beta[0] = np.log(y.sum() / np.exp(log_exposure).sum())
    for _ in range(rounds):
        eta = np.clip(design @ beta + log_exposure, -30, 30)
        mu = np.exp(eta)
        work = eta - log_exposure + (y - mu) / mu
        weighted = design * mu[:, None]
        new = np.linalg.pinv(weighted.T @ design) @ (weighted.T @ work)
        if np.abs(new - beta).max() <= tol * (1 + np.abs(beta).max()):
            return new
        beta = new
    return beta


IRLS_ROUNDS = 100


def poisson_irls(df: DataFrame, degree: int = 1, tol: float = 1e-10) -> DataFrame:
    """(gene, beta, deviance) from rows (gene, cell_id, value, z, exposure).

    The iteration of ``poisson_fit`` with its normal equations summed over the cells: a
    round is one aggregate by gene, and only its few numbers a gene reach the driver. They
    are broadcast to the rows, which are never moved.
    """
    spark = df.sparkSession
    df = written(df.select("gene", "value", "z", "exposure"), "counts")
    scale = df.groupBy("gene").agg(F.avg("z").alias("_m"), F.greatest(F.stddev_pop("z"), F.lit(1e-12)).alias("_s"))
    start = df.groupBy("gene").agg(F.sum("value").alias("y"), F.sum(F.greatest("exposure", F.lit(1e-12))).alias("e")).collect()  # one row a gene
    rows = df.join(F.broadcast(scale), "gene").select("gene", "value", ((F.col("z") - F.col("_m")) / F.col("_s")).alias("z"), F.log(F.greatest("exposure", F.lit(1e-12))).alias("o"))
    rows = written(rows, "irls")
    k = degree + 1
    beta = {r["gene"]: np.array([np.log(r["y"] / r["e"]) if r["y"] > 0 else -20.0] + [0.0] * degree) for r in start}
    going = {r["gene"] for r in start if r["y"] > 0}

    def fitted(genes) -> DataFrame:
        now = spark.createDataFrame([(g, beta[g].tolist()) for g in sorted(genes)], "gene string, b array<double>")
        line = sum((F.col("b")[i] * F.pow("z", F.lit(i)) for i in range(1, k)), F.col("b")[0])
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line + F.col("o")))
        return rows.join(F.broadcast(now), "gene").withColumn("eta", eta).withColumn("mu", F.exp("eta"))

    for _ in range(IRLS_ROUNDS):
        if not going:
            break
        work = F.col("eta") - F.col("o") + (F.col("value") - F.col("mu")) / F.col("mu")
        got = fitted(going).groupBy("gene").agg(
            *(F.sum(F.col("mu") * F.pow("z", F.lit(i))).alias(f"w{i}") for i in range(2 * degree + 1)),
            *(F.sum(F.col("mu") * work * F.pow("z", F.lit(i))).alias(f"v{i}") for i in range(k)),
        ).collect()  # a few numbers a gene
        for r in got:
            normal = np.array([[r[f"w{i + j}"] for j in range(k)] for i in range(k)])
            new = np.linalg.pinv(normal) @ np.array([r[f"v{i}"] for i in range(k)])
            if np.abs(new - beta[r["gene"]]).max() <= tol * (1 + np.abs(beta[r["gene"]]).max()):
                going.discard(r["gene"])
            beta[r["gene"]] = new
    dev = F.when(F.col("value") > 0, F.col("value") * F.log(F.col("value") / F.col("mu"))).otherwise(0.0) - (F.col("value") - F.col("mu"))
    return fitted(beta).groupBy("gene", F.col("b").alias("beta")).agg((2 * F.sum(dev)).alias("deviance"))
