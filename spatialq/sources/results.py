"""Readers and writers of run results, manifests and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([
    T.StructField("run_name", T.StringType()), T.StructField("method", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("stat_true", T.DoubleType()), T.StructField("stat_perm", T.ArrayType(T.DoubleType())),
    T.StructField("runtime_sec", T.DoubleType()), T.StructField("n_cells", T.LongType()), T.StructField("n_genes", T.LongType()),
    T.StructField("config", T.StringType()), T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
])


def write_results(results: DataFrame, path: str, by_type: bool = False) -> None:
    """One JSON row a run, by cell type if asked; the whole configuration is kept."""
    out = results.write.mode("overwrite")
    (out.partitionBy("cell_type") if by_type else out).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files below a folder; the schema is fixed, so nothing is read to infer it."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of ``runs`` of a JSON manifest."""
    kind = T.StructType([T.StructField("runs", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    return spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("runs").alias("run"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; missing values are empty fields."""
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def write_history(history: DataFrame, path: str) -> None:
    """Training losses (epoch, slot, rerun, variant, loss), as Parquet by slot and epoch."""
    history.sortWithinPartitions("slot", "rerun", "epoch").write.mode("overwrite").parquet(path)


def write_svg(found: DataFrame, path: str) -> None:
    """Genes of all gradients in one sorted CSV: by gradient, p-value and name."""
    order = [c for c in ("gradient", "p_value", "gene") if c in found.columns]
    found.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)  # one row a gene


def write_significant(tests: DataFrame, path: str, alpha: float = 0.05) -> None:
    """The genes of (gene, p_value, q_value) whose q-value is below alpha, as sorted CSV."""
    write_svg(tests.filter(F.col("q_value") < alpha), path)


def write_qc(qc: DataFrame, path: str) -> None:
    """Quality columns by cell, as Parquet."""
    qc.write.mode("overwrite").parquet(path)


def write_cells(cells: DataFrame, expr: DataFrame, path: str) -> None:
    """The normalised layout: cells, and measurements sorted by gene so that a gene filter skips row groups."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    expr.repartitionByRange("gene", "cell_id").sortWithinPartitions("gene", "cell_id").write.mode("overwrite").parquet(f"{path}/expr")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/expr")


def read_quarantined(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged) of CSV files: rows that fit the schema, and (file, line, reason) of those that do not.

    Input files are never changed; a line with other fields than the schema's, or with a value of
    another kind, goes to the side and the job goes on. A row is a line; lines equal to the first
    file's first one are headings.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    if header:
        first = spark.read.text(sorted(spark.read.text(path).inputFiles())[:1]).first()
        lines = lines.filter(F.col("line") != (first[0] if first else ""))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    parsed = F.from_csv("line", f"{schema}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    raw = lines.withColumn("_row", parsed)
    fields = F.size(F.split("line", ","))
    reason = F.when(fields != len(names), F.concat(fields.cast("string"), F.lit(f" of {len(names)} fields"))).otherwise("a value of another kind")
    bad = F.col("_row._damaged").isNotNull()
    return raw.filter(~bad).select(*(F.col(f"_row.{n}").alias(n) for n in names)), raw.filter(bad).select("file", "line", reason.alias("reason"))


def write_region_manifest(regions: DataFrame, base: dict, folder: str) -> int:
    """One manifest row and one configuration a region of regions(cell_type, region, n_cells, ...); returns their number.

    A configuration is the base one with the region's name, cell type and cells as filters. Rows go to
    ``manifest`` as Parquet, configurations to ``configs`` as one JSON line a region.
    """
    import copy
    import json

    named = regions.withColumn("run_name", F.concat_ws("_r", F.translate("cell_type", " /", "__"), F.col("region").cast("string")))
    named.write.mode("overwrite").parquet(f"{folder}/manifest")
    out = []
    for r in named.select("run_name", "cell_type", "region").orderBy("run_name").collect():  # one row a region
        c = copy.deepcopy(base)
        c.setdefault("output", {})["run_name"] = r["run_name"]
        c.setdefault("data", {})["obs_filters"] = c.get("data", {}).get("obs_filters", {}) | {"cell_type": r["cell_type"], "region": r["region"]}
        out.append((r["run_name"], json.dumps(c, sort_keys=True)))
    regions.sparkSession.createDataFrame(out, "run_name string, config string").coalesce(1).write.mode("overwrite").json(f"{folder}/configs")
    return len(out)
