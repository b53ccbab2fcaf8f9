"""Nulls that keep each gene's variogram, and random smooth axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..sources.scratch import written
from . import halo
from .moran import centred
from .nulls import permute
from .ranks import bucket_rank, value_bucket
from .vectors import total


def normal(seed: int, *parts: Column | str) -> Column:
    """A normal number from two uniforms of the parts' hashes."""
    u1, u2 = (1 - uniform(seed, *parts, F.lit(k)) for k in "ab")
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def half_squares(rows: DataFrame, radius: float, bins: int) -> DataFrame:
    """(slot, bin, gamma): half the mean squared difference over the pairs of a bin, place by place of rows(slot, cell_id, x, y, v)."""
    sums = halo.squared_differences(rows, radius, bins).groupBy("slot", "bin").agg(total("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("slot", "bin", F.transform("s", lambda s: s / (2 * F.col("n"))).alias("gamma"))


def variogram_matched(cells: DataFrame, expr: DataFrame, n: int, seed: int, radius: float, widths: list[float], bins: int) -> tuple[DataFrame, DataFrame]:
    """(choices, nulls) of standardised measurements.

    Each null deals the cells' measurements anew, smooths them with kernels of every width and fits, gene
    by gene, the true variogram up to the radius by ``alpha + beta * smoothed variogram``. The width of
    least squared error is chosen (ties: the first), and the null is ``sqrt(|beta|)`` times the smoothed
    values plus ``sqrt(|alpha|)`` times white noise.

    choices(slot, g, width, alpha, beta), g the place in gene order; nulls(slot, cell_id, a), slot 0 the truth.
    A null is one row a cell, with all genes in an array; neighbours meet by tile.
    """
    z = written(cells.select("cell_id", "x", "y").join(centred(expr, True), "cell_id"), "standardised")
    dealt = permute(z.select("cell_id", "z"), n, seed, ["z"]).filter("slot > 0").join(z.select("cell_id", "x", "y"), "cell_id").withColumnRenamed("z", "v")
    y = written(halo.smoothed(dealt, radius, widths), "smoothed")
    true = half_squares(z.select(F.lit(0).alias("slot"), "cell_id", "x", "y", F.col("z").alias("v")), radius, bins).select("bin", F.posexplode("gamma").alias("g", "t"))
    null = half_squares(y.withColumnRenamed("s", "v"), radius, bins).select("slot", "bin", F.posexplode("gamma").alias("p", "s"))
    genes = z.select(F.size("z")).first()[0]  # one row
    null = null.select("slot", "bin", (F.col("p") % genes).alias("g"), F.call_function("div", F.col("p"), F.lit(genes)).alias("k"), "s")
    fit = null.join(true, ["bin", "g"]).groupBy("slot", "g", "k").agg(
        F.count("*").alias("m"), F.avg("s").alias("ms"), F.avg("t").alias("mt"), F.var_pop("s").alias("vs"), F.var_pop("t").alias("vt"), F.covar_pop("s", "t").alias("c")
    )
    beta = F.when(F.col("vs") > 0, F.col("c") / F.col("vs")).otherwise(0.0)
    fit = fit.withColumn("beta", beta).withColumn("alpha", F.col("mt") - F.col("beta") * F.col("ms")).withColumn("e", F.col("m") * (F.col("vt") - F.col("beta") * F.col("c")))
    best = written(fit.groupBy("slot", "g").agg(F.min(F.struct("e", "k", "alpha", "beta")).alias("b")).select("slot", "g", "b.k", "b.alpha", "b.beta"), "choices")
    widest = F.array(*(F.lit(float(w)) for w in widths))
    packed = best.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("g", "k", "alpha", "beta"))).alias("c"))  # one entry a gene
    noise = lambda g: normal(seed, "slot", "cell_id", g)
    value = F.transform("c", lambda c: F.sqrt(F.abs(c["beta"])) * F.get("s", (c["k"] * genes + c["g"]).cast("int")) + F.sqrt(F.abs(c["alpha"])) * noise(c["g"]))
    nulls = y.join(packed, "slot").select("slot", "cell_id", value.alias("a"))
    choices = best.select("slot", "g", F.get(widest, F.col("k").cast("int")).alias("width"), "alpha", "beta")
    return choices, z.select(F.lit(0).alias("slot"), "cell_id", F.col("z").alias("a")).unionByName(nulls)


def smooth_axes(cells: DataFrame, draws: int, length: float, features: int, seed: int, key: str = "lobule") -> DataFrame:
    """(key, draw, cell_id, value): random smooth fields over cells(key, cell_id, x, y), coordinates standardised by key.

    A field is ``sqrt(2 / features)`` times a sum of cosines with normal frequencies of deviation 1 / length
    and uniform phases. Its covariance goes to exp(-d^2 / (2 length^2)) with the number of features, and no
    pair of cells is looked at: one pass a cell.
    """
    stats = cells.groupBy(key).agg(*(f(c).alias(o + c) for c in "xy" for f, o in ((F.avg, "_m"), (F.stddev_pop, "_s"))))
    waves = stats.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(features - 1))))
    waves = waves.select(
        key, "draw", "m",
        *((normal(seed, key, "draw", "m", F.lit(c)) / length).alias("w" + c) for c in "xy"),
        (F.lit(2 * math.pi) * uniform(seed, key, "draw", "m", F.lit("p"))).alias("p"),
    )
    waves = waves.groupBy(key, "draw").agg(F.sort_array(F.collect_list(F.struct("m", "wx", "wy", "p"))).alias("f"))  # ``features`` entries
    zx, zy = ((F.col(c) - F.col("_m" + c)) / (F.col("_s" + c) + 1e-8) for c in "xy")
    z = cells.join(stats, key).select(key, "cell_id", zx.alias("zx"), zy.alias("zy"))
    wave = F.aggregate("f", F.lit(0.0), lambda s, f: s + F.cos(f["wx"] * F.col("zx") + f["wy"] * F.col("zy") + f["p"]))
    return z.join(waves, key).select(key, "draw", "cell_id", (wave * math.sqrt(2 / features)).alias("value"))


def place(df: DataFrame, keys: list[str], column: str, per_task: int = 200_000) -> DataFrame:
    """df with _r, its rank by a column within keys, ties by cell_id, in buckets of bounded size."""
    return bucket_rank(df, keys, value_bucket(df, column, per_task), [column, "cell_id"])


def axis_recovery(cells: DataFrame, draws: int, length: float, features: int, seed: int, key: str = "lobule") -> tuple[DataFrame, DataFrame]:
    """(observed, nulls) of cells(key, cell_id, x, y, axis, target): |rank correlation| with the target.

    observed(key, n_cells, rho) of the axis; nulls(key, draw, rho) of random smooth axes.
    """
    rank = lambda df, keys, c, name: place(df, keys, c).select(*keys, "cell_id", F.col("_r").alias(name))
    target = written(rank(cells, [key], "target", "rt"), "target")
    own = rank(cells, [key], "axis", "ra").join(target, [key, "cell_id"])
    observed = own.groupBy(key).agg(F.count("*").alias("n_cells"), F.abs(F.corr("ra", "rt")).alias("rho"))
    fields = written(smooth_axes(cells, draws, length, features, seed, key), "axes")
    nulls = rank(fields, [key, "draw"], "value", "ra").join(target, [key, "cell_id"]).groupBy(key, "draw").agg(F.abs(F.corr("ra", "rt")).alias("rho"))
    return observed, nulls


def recovery_by_key(observed: DataFrame, nulls: DataFrame, key: str = "lobule") -> DataFrame:
    """(key, n_cells, observed, null_mean, p_value): p is the share of random axes that recover the target as well."""
    both = nulls.join(observed.withColumnRenamed("rho", "observed"), key)
    return both.groupBy(key, "n_cells", "observed").agg(F.avg("rho").alias("null_mean"), F.avg((F.col("rho") >= F.col("observed")).cast("double")).alias("p_value"))


def recovery(observed: DataFrame, nulls: DataFrame, key: str = "lobule") -> DataFrame:
    """One row over all keys: the mean observed |rho| against the means of one random axis a key."""
    truth = observed.agg(F.count("*").alias("n_lobules"), F.avg("rho").alias("observed"))
    means = nulls.groupBy("draw").agg(F.avg("rho").alias("rho"))
    both = means.crossJoin(F.broadcast(truth))  # one row
    return both.groupBy("n_lobules", "observed").agg(F.avg("rho").alias("null_mean"), F.avg((F.col("rho") >= F.col("observed")).cast("double")).alias("p_value"))
