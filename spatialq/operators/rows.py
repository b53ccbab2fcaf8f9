"""Row selection: filters, crops, samples and label encoding."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StringType

from ..functions.portable import order_key
from ..functions.scalar import finite

RANGE_OPS = {
    "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v, "lte": lambda c, v: c <= v, "eq": lambda c, v: c == v, "ne": lambda c, v: c != v,
}


#: Bounds of the narrower integral types.
LIMITS = {"byte": 1 << 7, "short": 1 << 15, "integer": 1 << 31}


def need(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def equals_text(df: DataFrame, name: str, value: object) -> Column:
    """Whether a column equals a value as text, compared in the column's own type where that can reach the scan."""
    kind, text, c = df.schema[name].dataType, str(value), F.col(name)
    if isinstance(kind, StringType):
        return c == F.lit(text)
    if isinstance(kind, IntegralType):
        plain = re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text)
        return c == F.lit(int(text)).cast(kind) if plain and abs(int(text)) < LIMITS.get(kind.typeName(), 1 << 63) else c.cast("string") == F.lit(text)
    return c.cast("string") == F.lit(text)


def filter_equal(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns equal the values as text; all must hold."""
    need(df, wanted)
    for c, v in wanted.items():
        df = df.filter(equals_text(df, c, v))
    return df


def filter_range(df: DataFrame, wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Rows that meet all comparisons; values that are no finite numbers never do, not even for ``ne``.

    Numeric columns are compared as they are, so that the comparisons reach the scan.
    """
    need(df, wanted)
    for c, ops in wanted.items():
        kind = df.schema[c].dataType
        whole = isinstance(kind, IntegralType)
        v = F.col(c) if whole or isinstance(kind, DoubleType) else finite(F.col(c))
        df = df.filter(v.isNotNull()) if whole or not isinstance(kind, DoubleType) else df.filter((v > -math.inf) & (v < math.inf))
        for op, bound in ops.items():
            if op not in RANGE_OPS:
                raise ValueError(f"unknown comparison: {op}")
            exact = whole and float(bound).is_integer() and abs(bound) < LIMITS.get(kind.typeName(), 1 << 53)
            df = df.filter(RANGE_OPS[op](v, F.lit(int(bound)).cast(kind) if exact else F.lit(float(bound))))
    return df


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    need(df, columns)
    return df.dropna(subset=columns)


def some_rows(df: DataFrame) -> DataFrame:
    """df itself, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError("no rows are left")
    return df


def subset_by_index(df: DataFrame, index: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.join(index.select(key), key, "left_semi")


def subsample(df: DataFrame, n: int, seed: int, key: str = "cell_id") -> DataFrame:
    """n rows without replacement: a top-n by hash, which needs no global sort."""
    return df.withColumn("_k", order_key(seed, key)).orderBy("_k", key).limit(n).drop("_k")


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Codes 0, 1, ... in the labels' text order. Only distinct labels are ranked."""
    text = F.col(label).cast("string")
    codes = df.select(text.alias("_l")).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy("_l")) - 1).cast("bigint"))
    return df.withColumn("_l", text).join(codes, "_l").drop("_l")


def min_group(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels with at least so many rows, with codes made dense again."""
    big = df.groupBy(label).count().filter(F.col("count") >= least).select(label)
    return encode_labels(df.join(big, label, "left_semi"), label)


def zscore_columns(df: DataFrame, columns: list[str], tiny: float = 1e-8) -> DataFrame:
    """Columns minus mean over deviation; a deviation of tiny or less divides by 1."""
    stats = df.agg(*(F.avg(c).alias(f"_m{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        s = F.when(F.col(f"_s{c}") <= tiny, 1.0).otherwise(F.col(f"_s{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m{c}")) / s)
    return out.drop(*(f"_{k}{c}" for k in "ms" for c in columns))


def coordinate_scale(df: DataFrame, columns: list[str], tiny: float = 1e-8) -> DataFrame:
    """One row with the mean and the divisor of each column: _m<column>, _s<column>."""
    s = lambda c: F.stddev_pop(c)
    return df.agg(*(F.avg(c).alias(f"_m{c}") for c in columns), *(F.when(s(c) <= tiny, 1.0).otherwise(s(c)).alias(f"_s{c}") for c in columns))


def scaled(df: DataFrame, scale: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """df with its columns less the scale's means over its divisors, whichever rows the scale was taken from; or back again."""
    out = df.crossJoin(F.broadcast(scale))  # one row
    for c in columns:
        m, s = F.col(f"_m{c}"), F.col(f"_s{c}")
        out = out.withColumn(c, F.col(c) * s + m if back else (F.col(c) - m) / s)
    return out.drop(*(f"_{k}{c}" for k in "ms" for c in columns))


def crop(cells: DataFrame, bounds: dict[str, dict[str, float]]) -> DataFrame:
    """Axis-aligned crop on standardised coordinates, which are not standardised again."""
    return filter_range(zscore_columns(cells, ["x", "y"]), bounds)
