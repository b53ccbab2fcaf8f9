"""Null layouts, samples and folds: slot 0 is the truth, slots 1..n are nulls."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import order_key, uniform
from .ranks import hash_rank, id_rank
from .spatial import with_bin


def slots(df: DataFrame, n: int, first: int = 1) -> DataFrame:
    return df.withColumn("slot", F.explode(F.sequence(F.lit(first), F.lit(n))))


def permute(df: DataFrame, n: int, seed: int, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(slot, cell_id, columns): each null deals the rows' columns anew among the cells, within keys.

    Cells are ranked by id once and by hash in every slot; rank meets rank. Ranks come
    from bounded buckets, so no task holds all cells of a slot.
    """
    rows = df.count()
    own = slots(id_rank(df.select("cell_id", *keys), list(keys), "cell_id", rows), n)
    dealt = hash_rank(slots(df.select("cell_id", *keys, *columns), n), ["slot", *keys], order_key(seed, "slot", "cell_id"), "cell_id", rows=rows)
    nulls = own.join(dealt.drop("cell_id"), ["slot", *keys, "_r"]).select("slot", "cell_id", *columns)
    return df.select(F.lit(0).alias("slot"), "cell_id", *columns).unionByName(nulls)


def coordinate_permutation(cells: DataFrame, n: int, seed: int) -> DataFrame:
    return permute(cells, n, seed, ["x", "y"])


def block_permutation(cells: DataFrame, n: int, seed: int, radius: float, shape: str = "square", jitter: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(slot, cell_id, x, y): block centroids trade places, cells keep their offsets to them.

    keys: columns, such as the cell type, each value of which has a mesh and blocks of its own.

    Each slot may shift the mesh by hash-derived uniforms in (-radius, radius). Only
    blocks are ranked; a slot with one block stays as it is.
    """
    many = slots(cells.select("cell_id", "x", "y", *keys), n)
    dx, dy = (((uniform(seed, "slot", *keys, F.lit(a)) * 2 - 1) * radius if jitter else F.lit(0.0)) for a in ("jx", "jy"))
    own = ["slot", *keys]
    shifted = many.select(*own, "cell_id", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    tiled = with_bin(shifted, radius, shape).select(*own, "cell_id", "bin", F.col("_x").alias("x"), F.col("_y").alias("y"))
    blocks = tiled.groupBy(*own, "bin").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    a = blocks.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy("bin")))
    b = blocks.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(order_key(seed, *own, "bin"), "bin")))
    move = a.join(b.select(*own, "_r", F.col("cx").alias("tx"), F.col("cy").alias("ty")), [*own, "_r"])
    moved = tiled.join(move.select(*own, "bin", (F.col("tx") - F.col("cx")).alias("mx"), (F.col("ty") - F.col("cy")).alias("my")), [*own, "bin"])
    nulls = moved.select("slot", "cell_id", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"))
    return cells.select(F.lit(0).alias("slot"), "cell_id", "x", "y").unionByName(nulls)


def perturb(cells: DataFrame, n: int, seed: int, delta: float) -> DataFrame:
    """(slot, cell_id, x, y): normal jitter of delta times each axis range, clipped to the bounding box."""
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def normal(axis: str):
        u1, u2 = (1 - uniform(seed, "slot", "cell_id", F.lit(axis + k)) for k in "ab")
        return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)

    def moved(axis: str):
        lo, hi = F.col(axis + "0"), F.col(axis + "1")
        return F.least(hi, F.greatest(lo, F.col(axis) + normal(axis) * delta * (hi - lo))).alias(axis)

    nulls = slots(cells.select("cell_id", "x", "y"), n).crossJoin(F.broadcast(box)).select("slot", "cell_id", moved("x"), moved("y"))
    return cells.select(F.lit(0).alias("slot"), "cell_id", "x", "y").unionByName(nulls)


def subset_masks(cells: DataFrame, fractions: list[float], draws: int, seed: int) -> DataFrame:
    """(fraction, draw, cell_id): random subsets of clip(round(f n), 1, n - 1) cells."""
    n = cells.count()
    grid = [(f, d, max(1, min(n - 1, round(f * n)))) for f in fractions for d in range(draws)]
    spec = F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(d).alias("draw"), F.lit(s).alias("size")) for f, d, s in grid))
    rows = cells.select("cell_id", F.explode(spec).alias("g")).select("g.*", "cell_id")
    ranked = hash_rank(rows, ["fraction", "draw"], order_key(seed, "fraction", "draw", "cell_id"), "cell_id", rows=n)
    return ranked.filter("_r <= size").select("fraction", "draw", "cell_id")


def kfold(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """(cell_id, fold): the first n % k folds have one cell more; more folds than cells are an error."""
    if k < 2:
        raise ValueError("k must be at least 2")
    n = cells.count()
    if k > n:
        raise ValueError(f"{k} folds of {n} cells")
    ranked = hash_rank(cells.select("cell_id"), [], order_key(seed, "cell_id"), "cell_id", rows=n)
    size, extra = divmod(n, k)
    r, first = F.col("_r") - 1, extra * (size + 1)
    fold = F.when(r < first, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - first) / max(size, 1)))
    return ranked.select("cell_id", fold.cast("int").alias("fold"))
