"""Measurements packed by cell, and sums of packed products."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(expr: DataFrame, name: str = "a") -> DataFrame:
    """(cell_id, a): a cell's values in gene order, one row a cell. Every cell must have every gene."""
    v = expr.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("v"))
    return v.select("cell_id", F.col("v.value").alias(name))


def total(a: Column) -> Column:
    """The sums of arrays of one length, place by place, by partial aggregates."""
    return vector_to_array(Summarizer.sum(array_to_vector(a)))


def gene_order(expr: DataFrame) -> list[str]:
    return sorted(r[0] for r in expr.select("gene").distinct().collect())  # a dimension
