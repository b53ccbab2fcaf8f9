"""Shared helpers: scratch tables, column picking and zero-copy views of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by their exact names, also when other columns differ from them in case only.

    A name that occurs twice takes its first column.
    """
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column without copying; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
