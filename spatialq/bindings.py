"""How general tables stand in for cells, coordinates and measurements.

cells(cell_id, x, y, cell_type), expr(cell_id, gene, value) in long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE_GENES = 62


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cells: the first two elements are coordinates."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").alias("cell_type")
    )


def dense_expr(spark: SparkSession, sf_dir: str, genes: int = DENSE_GENES, with_x: bool = False) -> DataFrame:
    """The other elements as measurements g02, g03, ..., unfolded in one pass over the vectors; with_x: beside the cell's x."""
    x = [F.col("embedding")[0].cast("double").alias("x")] if with_x else []
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), *x, F.posexplode(F.slice("embedding", 3, genes)).alias("i", "v"))
    return raw.select("cell_id", *(["x"] if with_x else []), F.concat(F.lit("g"), F.lpad((F.col("i") + 2).cast("string"), 2, "0")).alias("gene"), F.col("v").cast("double").alias("value"))


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("x"), (F.lit(400.0) * F.col("c_nationkey")).alias("y"), F.col("c_mktsegment").alias("cell_type")
    )


def count_rows(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, gene, value), a row a line item, not yet summed; with cells their other columns in place of cell_id.

    Cells meet the orders, which are fewer than the items.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    owners = orders if cells is None else orders.join(cells, "cell_id").drop("cell_id")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = items.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*owners.drop("o_orderkey").columns, F.col("p_brand").alias("gene"), F.col("l_quantity").alias("value"))


def count_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by customer and brand: a sparse matrix of integral counts; zeros are absent."""
    return count_rows(spark, sf_dir).groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: x in hours, y the value."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("cell_id"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000.0)).alias("x"),
        F.col("value").alias("y"),
        F.col("event_type").alias("cell_type"),
    )


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as study runs with a p-value and a statistic."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("condition"),
        F.col("o_orderstatus").alias("truth"),
        (((F.col("o_orderkey") * 7919) % 1000 + 1) / F.lit(1001.0)).alias("p_value"),
        F.col("o_totalprice").alias("stat"),
    )


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_type").alias("pathway"), F.col("p_brand").alias("gene")).distinct()
