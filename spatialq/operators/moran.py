"""Spatial autocorrelation of pairs within a radius, summed tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..sources.scratch import written
from .halo import matrix
from .spatial import radius_pairs
from .tiles import Group, grouped, median_distances
from .vectors import packed, total


def moran_of(n: Column, s0: Column, cross: Column, square: Column) -> Column:
    return F.when(square > 1e-12, n / s0 * cross / F.when(square > 1e-12, square))


def centred(expr: DataFrame, scale: bool = False) -> DataFrame:
    """(cell_id, z): a cell's measurements less the genes' means, over their deviations if asked, in gene order."""
    means = expr.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.col("value") - F.col("_m")
    return packed(expr.join(means, "gene").select("cell_id", "gene", (z / (F.col("_s") + 1e-8) if scale else z).alias("value")), "z")


def at_both_ends(edges: DataFrame, z: DataFrame) -> DataFrame:
    """edges with zi and zj: one row an edge, however many genes there are."""
    left = edges.join(z.select(F.col("cell_id").alias("i"), F.col("z").alias("zi")), "i")
    return left.join(z.select(F.col("cell_id").alias("j"), F.col("z").alias("zj")), "j")


def floor_of(median: float | None) -> float:
    """The least distance that an inverse distance is taken of: a small share of the median."""
    return max((median or 0.0) * 1e-4, 1e-9)


def crosses(cells: DataFrame, z: DataFrame, r: float, key: str | None = None) -> DataFrame:
    """(key, c, s0): sums of w zi zj by gene, and of w, over pairs within r in both directions; w is 1 / distance."""
    least = {k: floor_of(m) for k, m in median_distances(cells, r, key).items()}
    keys = [key] if key else []
    kind = "".join(f"{k} {dict(cells.dtypes)[k]}, " for k in keys) + "c array<double>, s0 double"
    if not least:  # no pairs
        return cells.sparkSession.createDataFrame([] if key else [(None, None)], kind)

    def run(t: pa.Table) -> pa.Table:
        g, k = Group(t, r), t.column(key)[0].as_py() if key else None
        v = matrix(g.table.column("z"))
        c, s0 = np.zeros(v.shape[1]), 0.0
        for a, b, d, near in g.pairs():
            w = np.where(near, 1.0 / np.maximum(d, least[k]), 0.0)
            c, s0 = c + (v[a] * (w @ v[b])).sum(0), s0 + w.sum()
        some = int(s0 > 0)
        own = {key: pa.array([k] * some, t.schema.field(key).type)} if key else {}
        return pa.table(own | {"c": pa.array([(2 * c).tolist()] * some, pa.list_(pa.float64())), "s0": pa.array([2 * s0] * some, pa.float64())})

    rows = cells.select(*keys, "cell_id", "x", "y").join(z, "cell_id")
    return grouped(rows, r, keys, run, kind, cells).groupBy(*keys).agg(total("c").alias("c"), F.sum("s0").alias("s0"))


def squares(expr: DataFrame) -> DataFrame:
    """One row with n and q: cells, and sums of squares by gene in gene order."""
    v = expr.groupBy("gene").agg((F.var_pop("value") * F.count("*")).alias("q"), F.count("*").alias("n"))
    return v.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("gene", "q"))).alias("g")).select("n", F.col("g.gene").alias("gene"), F.col("g.q").alias("q"))


def morans_i(cells: DataFrame, expr: DataFrame, r: float) -> DataFrame:
    """(gene, moran) on dense measurements. A cell's values move with its place; pairs are summed where they meet."""
    out = squares(expr).crossJoin(F.broadcast(crosses(cells, centred(expr), r)))
    pairs = F.arrays_zip(F.col("gene").alias("gene"), F.col("q").alias("q"), F.coalesce("c", F.transform("q", lambda _: F.lit(0.0))).alias("c"))
    rows = out.select("n", "s0", F.explode(pairs).alias("g"))
    return rows.select(F.col("g.gene").alias("gene"), moran_of(F.col("n"), F.col("s0"), F.col("g.c"), F.col("g.q")).alias("moran"))


def moran_slots(slots: DataFrame, expr: DataFrame, r: float) -> DataFrame:
    """(slot, moran): mean over genes for each layout slots(slot, cell_id, x, y)."""
    slots = written(slots.select("slot", "cell_id", "x", "y"), "slots")
    out = crosses(slots, centred(expr), r, "slot").crossJoin(F.broadcast(squares(expr)))
    rows = out.select("slot", "n", "s0", F.explode(F.arrays_zip("q", "c")).alias("g"))
    each = rows.select("slot", moran_of(F.col("n"), F.col("s0"), F.col("g.c"), F.col("g.q")).alias("moran"))
    return each.groupBy("slot").agg(F.avg("moran").alias("moran"))


def lower_rank_p(stats: DataFrame) -> DataFrame:
    """(stat_true, p_value, p_upper): the share of nulls below the truth, near 1 for strong clustering, and its opposite."""
    truth = stats.filter("slot = 0").select(F.col("moran").alias("stat_true"))
    both = stats.filter("slot > 0").crossJoin(F.broadcast(truth))
    n = F.count("*") + 1
    return both.groupBy("stat_true").agg(
        ((F.count_if(F.col("moran") < F.col("stat_true")) + 1) / n).alias("p_value"), ((F.count_if(F.col("moran") >= F.col("stat_true")) + 1) / n).alias("p_upper")
    )


def bin_of(d: Column, r: float, bins: int, kind: str) -> Column:
    """The bin of a distance up to r: linear, of equal widths; log, of ratio 2 below r; near, as narrow near 0 as squares make them."""
    place = {"linear": d / (r / bins), "log": bins + F.log2(F.greatest(d, F.lit(r / 2**bins)) / r), "near": F.sqrt(d / r) * bins}[kind]
    return F.least(F.floor(place), F.lit(bins - 1)).cast("int")


def variogram(cells: DataFrame, expr: DataFrame, r: float, bins: int, kind: str = "linear", share: float = 1.0, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n_pairs, distance, covariance, gamma) of standardised values over pairs within r, gene-pooled.

    keys: columns of cells, such as the slot, each value of which is a layout. share < 1: a
    sample of the pairs, by a hash of both ends.
    """
    if share >= 1:
        return pooled(cells, centred(expr, True), r, bins, kind, list(keys))
    pairs = radius_pairs(cells, r, keys).filter(uniform(seed, "i", "j") < share)
    both = at_both_ends(pairs.withColumn("bin", bin_of(F.col("d"), r, bins, kind)), centred(expr, True))
    mean = F.aggregate(F.zip_with("zi", "zj", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) / F.size("zi")
    return both.groupBy(*keys, "bin").agg(F.count("*").alias("n_pairs"), F.avg("d").alias("distance"), F.avg(mean).alias("covariance")).withColumn("gamma", 1 - F.col("covariance"))


def bins_of(d: np.ndarray, r: float, bins: int, kind: str) -> np.ndarray:
    """As bin_of."""
    if kind == "log":
        place = bins + np.log2(np.maximum(d, r / 2**bins) / r)
    else:
        place = d / (r / bins) if kind == "linear" else np.sqrt(d / r) * bins
    return np.minimum(np.floor(place), bins - 1).astype(np.int64)


def pooled(cells: DataFrame, z: DataFrame, r: float, bins: int, kind: str, keys: list[str]) -> DataFrame:
    """The variogram over all pairs: each tile adds up its own by bin."""

    def run(t: pa.Table) -> pa.Table:
        g = Group(t, r)
        v = matrix(g.table.column("z"))
        n, d_sum, c_sum = np.zeros(bins, np.int64), np.zeros(bins), np.zeros(bins)
        for a, b, d, near in g.pairs():
            own = d[near]
            at = bins_of(own, r, bins, kind)
            n += np.bincount(at, minlength=bins)
            d_sum += np.bincount(at, own, bins)
            c_sum += np.bincount(at, (v[a] @ v[b].T)[near], bins) / v.shape[1]
        some = np.flatnonzero(n)
        first = {k: pa.array([t.column(k)[0].as_py()] * len(some), t.schema.field(k).type) for k in keys}
        return pa.table(first | {"bin": some.astype(np.int32), "n": n[some], "d": d_sum[some], "c": c_sum[some]})

    types = dict(cells.dtypes)
    rows = cells.select(*keys, "cell_id", "x", "y").join(z, "cell_id")
    each = grouped(rows, r, keys, run, "".join(f"{k} {types[k]}, " for k in keys) + "bin int, n long, d double, c double", cells)
    out = each.groupBy(*keys, "bin").agg(F.sum("n").alias("n_pairs"), (F.sum("d") / F.sum("n")).alias("distance"), (F.sum("c") / F.sum("n")).alias("covariance"))
    return out.withColumn("gamma", 1 - F.col("covariance"))


def variogram_bands(slots: DataFrame, expr: DataFrame, r: float, bins: int, low: float = 0.05, high: float = 0.95, **how) -> DataFrame:
    """(bin, gamma, low, high): the true layout's variogram and quantiles over the null layouts of slots."""
    each = variogram(slots, expr, r, bins, keys=("slot",), **how)
    nulls = F.when(F.col("slot") > 0, F.col("gamma"))  # one value a layout and bin
    return each.groupBy("bin").agg(F.max(F.when(F.col("slot") == 0, F.col("gamma"))).alias("gamma"), F.percentile(nulls, F.lit(low)).alias("low"), F.percentile(nulls, F.lit(high)).alias("high"))
