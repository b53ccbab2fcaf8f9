"""Objects of an image mask: connected pixels by runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

#: Columns of a block within which runs of neighbouring rows meet.
BLOCK = 256


def colour_mask(red: Column, green: Column, blue: Column, least: tuple[int, int, int], most: tuple[int, int, int]) -> Column:
    """Whether a pixel's channels lie strictly between the bounds."""
    inside = F.lit(True)
    for c, lo, hi in zip((red, green, blue), least, most, strict=True):
        inside = inside & (c > lo) & (c < hi)
    return inside


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """(run, row, first, last): stretches of neighbouring columns in each row of pixels(row, col), which may repeat.

    A run is named by its row and first column. A window sorts one image row at a time.
    """
    p = pixels.select(F.col("row").cast("bigint"), F.col("col").cast("bigint")).distinct()
    island = F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col"))
    runs = p.withColumn("_g", island).groupBy("row", "_g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_g")
    return runs.select((F.col("row") * F.lit(1 << 31) + F.col("first")).alias("run"), "row", "first", "last")


def touching(runs: DataFrame, corners: bool = False) -> DataFrame:
    """(a, b): runs of neighbouring rows that share a column, or a corner if asked.

    Runs meet in blocks of columns, so a row with many runs is no product of them; a pair is
    taken in the first block that both touch.
    """
    reach = 1 if corners else 0
    blocks = F.sequence(F.floor((F.col("first") - reach) / BLOCK), F.floor((F.col("last") + reach) / BLOCK))
    each = runs.withColumn("_k", F.explode(blocks))
    below = each.select((F.col("row") - 1).alias("row"), F.col("run").alias("b"), F.col("first").alias("f"), F.col("last").alias("l"), "_k")
    met = each.join(below, ["row", "_k"]).filter((F.col("first") <= F.col("l") + reach) & (F.col("f") <= F.col("last") + reach))
    start = F.greatest(F.floor((F.col("first") - reach) / BLOCK), F.floor((F.col("f") - reach) / BLOCK))
    return met.filter(F.col("_k") == start).select(F.col("run").alias("a"), "b")


def mask_objects(pixels: DataFrame, least: int = 1, corners: bool = False) -> DataFrame:
    """(object, n_pixels, cx, cy) of the connected objects of at least so many pixels of pixels(row, col).

    Objects are numbered by their first run, row by row; cx, cy are mean columns and rows.
    Components run over runs, of which there are far fewer than pixels.
    """
    runs = pixel_runs(pixels)
    comp = components(touching(runs, corners))
    own = runs.join(comp.withColumnRenamed("v", "run"), "run", "left").withColumn("c", F.coalesce("c", "run"))
    n = F.col("last") - F.col("first") + 1
    sums = own.groupBy("c").agg(F.sum(n).alias("n_pixels"), F.sum((F.col("first") + F.col("last")) / 2 * n).alias("sx"), F.sum(F.col("row") * n).alias("sy"))
    big = sums.filter(F.col("n_pixels") >= least)
    number = F.row_number().over(Window.orderBy("c")) - 1  # one row an object
    return big.select(number.alias("object"), "n_pixels", (F.col("sx") / F.col("n_pixels")).alias("cx"), (F.col("sy") / F.col("n_pixels")).alias("cy"))
