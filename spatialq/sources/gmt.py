"""Gene-set files: one set a line, name, description, then symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_lines(lines: DataFrame) -> DataFrame:
    """(pathway, gene), distinct. Fields are split at tabs, or at blanks where a line has no tab; short lines are skipped."""
    parts = F.when(F.col("line").contains("\t"), F.split("line", "\t")).otherwise(F.split(F.trim("line"), r"\s+"))
    fields = lines.select(F.transform(parts, lambda x: F.trim(x)).alias("f")).filter(F.size("f") >= 3)
    genes = fields.select(F.col("f")[0].alias("pathway"), F.explode(F.slice("f", F.lit(3), F.size("f"))).alias("gene"))
    return genes.filter("gene <> ''").distinct()


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    return explode_lines(spark.read.text(path).withColumnRenamed("value", "line"))
