"""Coordinate matrices in text files, with their row and column names, as cells and measurements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a file, or of a folder's files in the order of their names, numbered from 0.

    Large files are read in blocks, in any order. Ids rise within a task, so a line's place in its block
    is its id less the block's least; blocks are counted, and the counts before each block are added up
    (one row a block). Lines are not moved.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    blocks = raw.groupBy("_f", "_s").agg(F.min("_i").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f", "_s")) - F.col("_n")
    base = blocks.select("_f", "_s", (before - F.col("_low")).alias("_base"))
    return raw.join(base, ["_f", "_s"]).select((F.col("_i") + F.col("_base")).alias("line"), "value")


@dataclass
class Matrix:
    """entries(i, j, value), 1-based, of a rows x columns matrix."""

    rows: int
    columns: int
    entries: DataFrame


def heading(spark: SparkSession, path: str) -> tuple[list[str], int, list[str]]:
    """The words of the first line, the number of the line with the sizes, and its words."""
    first = sorted(spark.read.text(path).inputFiles())[0]
    head: list[str] = []
    for n, row in enumerate(spark.read.text(first).toLocalIterator()):  # the comments, up to the sizes
        text = row[0].strip()
        if n == 0:
            head = text.lower().split()
        elif text and not text.startswith("%"):
            return head, n, text.split()
    raise ValueError(f"{path} has no line of sizes")


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """A coordinate matrix of real, integer or pattern values, general, symmetric or skew-symmetric.

    path: a file, plain or compressed, or a folder of parts whose first holds the heading. Another kind of
    matrix, a line that is no entry, a place outside the sizes or another number of entries is an error.
    """
    head, at, sizes = heading(spark, path)
    if len(head) != 5 or head[0] != "%%matrixmarket" or head[1:3] != ["matrix", "coordinate"] or head[3] not in ("real", "integer", "pattern") or head[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"{path}: no coordinate matrix of numbers: {' '.join(head)}")
    rows, columns, stored = map(int, sizes)
    pattern = head[3] == "pattern"
    text = F.trim("value")
    f = F.split(text, r"\s+")
    lines = numbered_lines(spark, path).filter((F.col("line") > at) & (text != "") & ~text.startswith("%")).select(f.alias("f"))
    get = lambda k, kind: F.get("f", F.lit(k)).try_cast(kind)
    entries = lines.select(get(0, "bigint").alias("i"), get(1, "bigint").alias("j"), (F.lit(1.0) if pattern else get(2, "double")).alias("value"), (F.size("f") == (2 if pattern else 3)).alias("whole"))
    fits = F.col("whole") & F.col("i").between(1, rows) & F.col("j").between(1, columns) & F.col("value").isNotNull()
    n, bad = entries.agg(F.count("*"), F.count_if(~F.coalesce(fits, F.lit(False)))).first()
    if bad or n != stored:
        raise ValueError(f"{path}: {bad} lines are no entries of a {rows} x {columns} matrix; {n} of {stored} entries")
    entries = entries.drop("whole")
    if head[4] != "general":
        sign = -1.0 if head[4].startswith("skew") else 1.0
        entries = entries.unionByName(entries.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("value") * sign).alias("value")))
    return Matrix(rows, columns, entries)


def names(spark: SparkSession, path: str, fields: int = 1) -> DataFrame:
    """(n, f): the tab-separated fields of each line, numbered from 1."""
    return numbered_lines(spark, path).filter("value <> ''").select((F.col("line") + 1).alias("n"), F.split("value", "\t").alias("f")).filter(F.size("f") >= fields)


def read_counts(spark: SparkSession, matrix: str, features: str, barcodes: str) -> tuple[DataFrame, DataFrame]:
    """(barcodes(cell_id), expr(cell_id, gene, value)) of a genes x cells matrix.

    features: id, symbol and kind by line; only expressed genes are kept where kinds are given. Symbols
    that come again get the number of their repetition: A, A-1, A-2. Name files must match the sizes.
    """
    m = read_matrix(spark, matrix)
    genes, cells = names(spark, features), names(spark, barcodes)
    for kind, df, want in (("features", genes, m.rows), ("barcodes", cells, m.columns)):
        if (n := df.count()) != want:
            raise ValueError(f"{n} {kind} for {want} lines of the matrix")
    genes = genes.select("n", F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("symbol"), F.get("f", F.lit(2)).alias("kind"))
    genes = genes.filter(F.col("kind").isNull() | (F.col("kind") == "Gene Expression"))
    again = F.row_number().over(Window.partitionBy("symbol").orderBy("n")) - 1
    genes = genes.withColumn("again", again).select(F.col("n").alias("i"), F.when(F.col("again") == 0, F.col("symbol")).otherwise(F.concat_ws("-", "symbol", "again")).alias("gene"))
    cells = cells.select(F.col("n").alias("j"), F.col("f")[0].alias("cell_id"))
    expr = m.entries.join(genes, "i").join(cells, "j").select("cell_id", "gene", "value")
    return cells.select("cell_id"), expr


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, x, y, in_tissue, array_row, array_col) of a list of positions without a header."""
    p = spark.read.schema(POSITIONS).csv(path)
    return p.select(F.col("barcode").alias("cell_id"), F.col("pxl_col_in_fullres").alias("x"), F.col("pxl_row_in_fullres").alias("y"), "in_tissue", "array_row", "array_col")


def require_all(left: DataFrame, right: DataFrame, on: str, columns: list[str], what: str) -> DataFrame:
    """left with right's columns; a row of left without a match, or with a null among them, is an error."""
    both = left.join(right, on, "left")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    n = both.filter(missing).count()
    if n:
        raise ValueError(f"{n} rows lack {what}")
    return both


def assemble(spark: SparkSession, matrix: str, features: str, barcodes: str, positions: str, tissue_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells(cell_id, x, y, ...), expr(cell_id, gene, value)): the matrix with the places of its cells.

    Every barcode needs a position. tissue_only: cells off the tissue go, and their measurements.
    """
    cells, expr = read_counts(spark, matrix, features, barcodes)
    cells = require_all(cells, read_positions(spark, positions), "cell_id", ["x", "y"], "coordinates")
    if tissue_only:
        cells = cells.filter("in_tissue = 1")
        expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    return cells, expr


def write_matrix(entries: DataFrame, rows: int, columns: int, path: str, compression: str = "none") -> None:
    """entries(i, j, value) as a folder of parts in order, the heading in the first."""
    n = entries.count()
    spark = entries.sparkSession
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{rows} {columns} {n}")], "j long, i long, value string")
    lines = entries.select(F.col("j").cast("long"), F.col("i").cast("long"), F.concat_ws(" ", "i", "j", F.col("value").cast("string")).alias("value"))
    ordered = head.unionByName(lines).repartitionByRange("j", "i").sortWithinPartitions("j", "i")
    ordered.select("value").write.option("compression", compression).text(path)


def write_names(df: DataFrame, order: str, fields: list[str], path: str, compression: str = "none") -> None:
    """One line a row, in order, as a folder of parts."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.concat_ws("\t", *fields).alias("value")).write.option("compression", compression).text(path)
