"""Simulated cells: layouts, latent depths and measurements, all from portable hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..functions.scalar import shape_mask


def lattice(spark: SparkSession, side: int, shape: str = "square") -> DataFrame:
    """Cell centres of a side x side lattice of the unit square that lie in the shape."""
    c = spark.range(side * side).select(
        F.col("id").alias("cell_id"), ((F.col("id") % side + 0.5) / side).alias("x"), ((F.floor(F.col("id") / side) + 0.5) / side).alias("y")
    )
    return c.filter(shape_mask(F.col("x"), F.col("y"), shape)).withColumn("cell_type", F.lit("all"))


def scattered(spark: SparkSession, n: int, seed: int, shape: str = "square") -> DataFrame:
    """About n uniform cells of the shape, by rejection from the unit square."""
    c = spark.range(n).select(F.col("id").alias("cell_id"), uniform(seed, "id", F.lit("x")).alias("x"), uniform(seed, "id", F.lit("y")).alias("y"))
    return c.filter(shape_mask(F.col("x"), F.col("y"), shape)).withColumn("cell_type", F.lit("all"))


def normal(seed: int, *parts) -> Column:
    u1, u2 = 1 - uniform(seed, *parts, F.lit("a")), uniform(seed, *parts, F.lit("b"))
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def latent(mode: str) -> Column:
    x, y = F.col("x"), F.col("y")
    return {
        "radial": F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)),
        "checkerboard": ((F.floor(x * 3) + F.floor(y * 3)) % 2).cast("double"),
        "fourier": F.sin(2 * math.pi * x) * F.cos(2 * math.pi * y),
        "noise": F.lit(0.0),
    }[mode]


def manifold(cells: DataFrame, mode: str, genes: int, sigma: float, seed: int) -> DataFrame:
    """(cell_id, gene, value): for each gene a random quadratic of the depth, plus normal noise."""
    e = cells.select("cell_id", latent(mode).alias("z"), F.explode(F.sequence(F.lit(1), F.lit(genes))).alias("g"))
    b1, b2 = (uniform(seed, "g", F.lit(k)) * 4 - 2 for k in ("b1", "b2"))
    v = b1 * F.col("z") + b2 * F.col("z") * F.col("z") + sigma * normal(seed, "g", "cell_id")
    return e.select("cell_id", F.concat(F.lit("g"), F.lpad(F.col("g").cast("string"), 3, "0")).alias("gene"), v.alias("value"))
