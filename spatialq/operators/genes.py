"""Gene selection over long measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import order_key


def exclude_genes(genes: DataFrame, patterns: list[str]) -> DataFrame:
    """genes that match none of the patterns."""
    keep = genes
    for p in patterns:
        keep = keep.filter(~F.col("gene").rlike(p))
    return keep


def panel(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select("gene").distinct(), "gene", "left_semi")


def panel_missing(genes: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("gene").distinct().join(genes, "gene", "left_anti")


def support(expr: DataFrame) -> DataFrame:
    """Cells with a value other than 0, for each gene."""
    return expr.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n_cells"))


def min_cells(expr: DataFrame, least: int) -> DataFrame:
    """Rows of genes with support; least <= 0 keeps all."""
    if least <= 0:
        return expr
    return expr.join(support(expr).filter(F.col("n_cells") >= least).select("gene"), "gene", "left_semi")


def universe(expr: DataFrame, least: int) -> DataFrame:
    """Genes with a count above 0 in at least so many cells."""
    return expr.filter("value > 0").groupBy("gene").agg(F.count("*").alias("n_cells")).filter(F.col("n_cells") >= least)


def random_panel(genes: DataFrame, n: int, seed: int) -> DataFrame:
    return genes.select("gene").distinct().withColumn("_k", order_key(seed, "gene")).orderBy("_k", "gene").limit(n).select("gene").orderBy("gene")


def resolve(symbols: DataFrame, genes: DataFrame) -> DataFrame:
    """Each symbol with its gene: the exact name, else the normalised one (before a bar, trimmed, upper case)."""

    def norm(c: Column) -> Column:
        return F.upper(F.trim(F.split_part(c, F.lit("|"), F.lit(1))))

    exact = genes.select(F.col("gene").alias("symbol"), F.col("gene").alias("exact")).distinct()
    loose = genes.groupBy(norm(F.col("gene")).alias("_n")).agg(F.min("gene").alias("loose"))
    return (
        symbols.join(exact, "symbol", "left").withColumn("_n", norm(F.col("symbol"))).join(loose, "_n", "left")
        .select("symbol", F.coalesce("exact", "loose").alias("gene"))
    )


def highly_variable(expr: DataFrame, n_cells: int | DataFrame, n_top: int, bins: int = 20, scale: float = 1e4, keys: tuple[str, ...] = ()) -> DataFrame:
    """(gene, mean, dispersion, score, rank): the Seurat recipe on long counts whose zeros may be absent.

    Counts are scaled to a common total and logged; means and variances (ddof 1) are
    those of the unlogged values over all cells; log dispersions are standardised in
    equal-width bins of the log mean; a bin with one gene scores 1.
    keys: columns of expr, such as the cell type, within which all of that is done;
    n_cells is then a table (keys, n).
    """
    total = expr.groupBy("cell_id").agg(F.sum("value").alias("_t"))
    v = F.col("value") * scale / F.col("_t")
    sums = expr.join(total.filter("_t > 0"), "cell_id").groupBy(*keys, "gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    sums = sums.join(n_cells.select(*keys, F.col("n").cast("double").alias("n")), list(keys)) if keys else sums.withColumn("n", F.lit(float(n_cells)))
    moments = sums.select(
        *keys, "gene", (F.col("s") / F.col("n")).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var")
    ).filter("mean > 0 AND var > 0")
    logs = moments.select(*keys, "gene", F.log1p("mean").alias("mean"), F.log(F.col("var") / F.col("mean")).alias("dispersion"))
    edge = logs.groupBy(*keys).agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width <= 0, 0).otherwise(F.least(F.floor((F.col("mean") - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1)))
    binned = (logs.join(edge, list(keys)) if keys else logs.crossJoin(F.broadcast(edge))).withColumn("bin", slot)
    by = binned.groupBy(*keys, "bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    score = F.when(F.col("_s").isNull() | (F.col("_s") == 0), 1.0).otherwise((F.col("dispersion") - F.col("_m")) / F.col("_s"))
    scored = binned.join(by, [*keys, "bin"]).select(*keys, "gene", "mean", "dispersion", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "gene"))).filter(F.col("rank") <= n_top)
