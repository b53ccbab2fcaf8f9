"""Transforms of long measurements expr(cell_id, gene, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .genes import highly_variable

EPS = 1e-8


def densify(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """One row for each cell and gene; absent values are 0. The genes are a dimension, not data-sized."""
    genes = expr.select("gene").distinct()
    grid = cells.select("cell_id").crossJoin(F.broadcast(genes))
    return grid.join(expr, ["cell_id", "gene"], "left").select("cell_id", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def library_size(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.log1p(F.greatest(F.sum("value"), F.lit(0.0))).alias("log_total"))


def cpm(expr: DataFrame, scale: float = 1e6) -> DataFrame:
    """Counts per million of the cell's total; cells of total 0 stay 0; negative counts are an error."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    ok = F.when(F.col("value") < 0, F.raise_error(F.lit("negative counts"))).otherwise(F.col("value"))
    return expr.withColumn("value", ok).withColumn("value", F.coalesce(F.try_divide(F.col("value") * scale, total), F.lit(0.0)))


def log1p(expr: DataFrame) -> DataFrame:
    ok = F.when(F.col("value") < 0, F.raise_error(F.lit("negative values"))).otherwise(F.log1p("value"))
    return expr.withColumn("value", ok)


def gene_stats(expr: DataFrame, keys: tuple[str, ...] = ("gene",)) -> DataFrame:
    return expr.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))


def zscore(expr: DataFrame, keys: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(value - mean) / (deviation + 1e-8) within the keys.

    Means come from a partial aggregate and a join with one row a gene, not from a
    window that would sort every gene's cells. These rows are sent to the values, which are not moved.
    """
    stats = gene_stats(expr, keys)
    return expr.join(F.broadcast(stats), list(keys)).withColumn("value", (F.col("value") - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def residuals(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Values minus their mean by cell type and gene."""
    typed = expr.join(cells.select("cell_id", "cell_type"), "cell_id")
    means = typed.groupBy("cell_type", "gene").agg(F.avg("value").alias("_m"))
    return typed.join(means, ["cell_type", "gene"]).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def type_size_factors(expr: DataFrame, cells: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Mean count by cell type and gene, at least ``floor``."""
    typed = expr.join(cells.select("cell_id", "cell_type"), "cell_id")
    return typed.groupBy("cell_type", "gene").agg(F.greatest(F.avg("value"), F.lit(floor)).alias("factor"))


def signal(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.avg(F.abs("value")).alias("signal"))


def qc(expr: DataFrame, prefix: str = "MT-") -> DataFrame:
    """Total, log total, genes seen and the share of genes with the prefix, by cell."""
    marked = F.when(F.upper("gene").startswith(prefix.upper()), F.col("value")).otherwise(0.0)
    a = expr.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"), F.sum(marked).alias("_p"))
    return a.select("cell_id", "total", F.log1p("total").alias("log_total"), "n_genes", F.coalesce(F.try_divide(100 * F.col("_p"), F.col("total")), F.lit(0.0)).alias("pct"))


def cp10k(expr: DataFrame) -> DataFrame:
    """log1p of counts per ten thousand of the cell's total, which counts as 1 at least; absent values are 0."""
    total = expr.groupBy("cell_id").agg(F.greatest(F.sum("value"), F.lit(1.0)).alias("_t"))
    return expr.join(total, "cell_id").withColumn("value", F.log1p(F.col("value") * 1e4 / F.col("_t"))).drop("_t")


def preprocess_by_type(expr: DataFrame, cells: DataFrame, n_top: int = 0, least: int = 0) -> DataFrame:
    """Inside each cell type: the most variable genes, of them those in enough cells, then CPM, log and z-score.

    expr is dense. n_top and least at 0 keep all genes.
    """
    kinds = cells.select("cell_id", "cell_type")
    if n_top or least:
        typed = expr.join(kinds, "cell_id")
        keep = typed.select("cell_type", "gene").distinct()
        if n_top:
            n = kinds.groupBy("cell_type").agg(F.count("*").alias("n"))
            keep = highly_variable(typed, n, n_top, keys=("cell_type",)).select("cell_type", "gene")
        if least:
            seen = typed.groupBy("cell_type", "gene").agg(F.count_if(F.col("value") != 0).alias("_n")).filter(F.col("_n") >= least)
            keep = keep.join(seen, ["cell_type", "gene"], "left_semi")
        expr = typed.join(keep, ["cell_type", "gene"], "left_semi").drop("cell_type")
    out = log1p(cpm(expr)).join(kinds, "cell_id")
    return zscore(out, ("cell_type", "gene"))
