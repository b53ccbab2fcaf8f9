"""Null measurements that keep the power of a grid's Fourier transform: (slot, cell_id, a), slot 0 the truth, a in gene order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..sources.scratch import written


def rows_of(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """(cell_id, x, y, a) of dense measurements."""
    v = expr.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("v"))
    return written(cells.select("cell_id", "x", "y").join(v, "cell_id").select("cell_id", "x", "y", F.col("v.value").alias("a")), "rows")


def grid_lines(cells: DataFrame) -> DataFrame:
    """(cell_id, i, j): row and column of each cell of a full grid; anything else is an error."""
    n, nx, ny, places = cells.agg(F.count("*"), F.countDistinct("x"), F.countDistinct("y"), F.countDistinct("x", "y")).first()
    if not n or nx * ny != n or places != n:
        raise ValueError("phases need a full grid of cells")
    at = []
    for c, name in (("y", "i"), ("x", "j")):
        lines = cells.select(c).distinct()
        rank = lines.selectExpr(c, f"row_number() OVER (ORDER BY {c}) - 1 AS {name}")  # one row a grid line
        at.append((c, rank))
    return cells.join(at[0][1], at[0][0]).join(at[1][1], at[1][0]).select("cell_id", "i", "j")


LINE = "slot int, cell_id long, i int, j int, re array<double>, im array<double>"


def transformed(df: DataFrame, line: str, along: str, forward: bool) -> DataFrame:
    """One pass of a two-dimensional transform: each line of each slot by itself."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(along)
        z = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
        z = np.fft.fft(z, axis=0) if forward else np.fft.ifft(z, axis=0)
        return part.assign(re=list(z.real), im=list(z.imag))

    return df.groupBy("slot", line).applyInPandas(run, LINE)


def phase_surrogates(cells: DataFrame, expr: DataFrame, n: int, seed: int) -> DataFrame:
    """Nulls with the phases of white noise added to each Fourier coefficient, alike for all genes.

    The transform is separable: grid rows, then columns, forth and back, each line in a
    task of its own. The noise travels as one more measurement.
    """
    rows = rows_of(cells, expr).join(grid_lines(cells), "cell_id")
    many = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u1, u2 = (1 - uniform(seed, "slot", "cell_id", F.lit(k)) for k in "ab")
    noise = F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)
    z = F.concat("a", F.array(noise))
    wave = many.select(F.col("slot").cast("int").alias("slot"), "cell_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), z.alias("re"), F.transform(z, lambda _: F.lit(0.0)).alias("im"))
    wave = transformed(transformed(wave, "i", "j", True), "j", "i", True)

    def turn(batches):
        for part in batches:
            z = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
            own, noise_ = z[:, :-1], z[:, -1:]
            size = np.abs(noise_)
            phase = np.where(size > 0, noise_ / np.where(size > 0, size, 1), 1.0)
            phase[(part["i"] == 0).to_numpy() & (part["j"] == 0).to_numpy()] = 1.0
            own = own * phase
            yield part.assign(re=list(own.real), im=list(own.imag))

    if not rows.isEmpty():
        wave = wave.mapInPandas(turn, LINE)
    back = transformed(transformed(wave, "j", "i", False), "i", "j", False).select("slot", "cell_id", F.col("re").alias("a"))
    return rows.select(F.lit(0).alias("slot"), "cell_id", "a").unionByName(back)


def standardised(nulls: DataFrame) -> DataFrame:
    """Every gene of every slot to mean 0 and deviation 1. Sums come by slot, so no cell is moved."""
    v = array_to_vector("a")
    stats = nulls.groupBy("slot").agg(F.count("*").alias("n"), *(vector_to_array(f(v)).alias(c) for c, f in (("m", Summarizer.mean), ("s", Summarizer.variance))))
    share = F.when(F.col("n") > 1, (F.col("n") - 1) / F.col("n")).otherwise(0.0)
    stats = stats.select("slot", "m", F.transform("s", lambda s: F.sqrt(s * share) + 1e-8).alias("s"))
    away = F.zip_with("a", "m", lambda v, m: v - m)
    return nulls.join(F.broadcast(stats), "slot").select("slot", "cell_id", F.zip_with(away, "s", lambda d, s: d / s).alias("a"))  # a row a slot
