"""Jump consistent hashing of stable keys to shards, with DataFrame functions only.

Defined results: a null key hashes as the text ``null``; repeated rows go to the same
shard and get slots of their own, in any order among themselves; a null text has size 1;
a very long text counts as one row, its bytes and checksum taken whole; empty tables give
empty results. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

#: Fixed values of the published generator (Lamping and Veach, 2014).
JUMP_MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648


def stable_key(key: Column) -> Column:
    """60 bits of the key's md5 as a non-negative bigint, the same in any engine."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard in [0, n_shards) of a non-negative bigint key; no ring table.

    A key's jumps rise strictly, so n_shards steps always reach the end (about
    ln(n_shards) of them do work). Products stay below 10**38 and thus exact in
    decimal(38, 0), whereas 64-bit products would overflow under ANSI rules.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    def step(acc: Column, _: Column) -> Column:
        k = ((acc["k"] * F.lit(Decimal(JUMP_MULTIPLIER))).cast("decimal(38,0)") + F.lit(Decimal(1))).cast("decimal(38,0)") % F.lit(Decimal(TWO_64))
        high = F.floor(k / F.lit(Decimal(TWO_33))).cast("double")
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(TWO_31)) / (high + 1.0))).cast("bigint")
        return F.when(
            acc["j"] < n_shards,
            F.struct(k.cast("decimal(20,0)").alias("k"), acc["j"].alias("b"), j.alias("j")),
        ).otherwise(acc)

    start = F.struct(
        key.cast("decimal(20,0)").alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")
    )
    steps = F.sequence(F.lit(1), F.lit(n_shards))
    return F.aggregate(steps, start, step, lambda acc: acc["b"].cast("int"))


def shard_table(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", rows_per_group: int = 50_000) -> DataFrame:
    """Shard, slot and the shard after one more is appended, for each row.

    Slots number a shard's rows without gaps: rows are hashed into groups of about
    rows_per_group, each group is numbered on its own and shifted by the rows of the
    groups before it, so no task ever holds a whole shard. Repeated rows are spread
    over groups too: the group hash includes the row's place in the written table.
    """
    k = stable_key(F.col(key))
    rows = written(
        pick(docs, key, text).select(
            F.col(key).alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            jump_hash(k, n_shards).alias("shard"),
            jump_hash(k, n_shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shards",
    )
    groups = max(1, -(-rows.count() // (n_shards * rows_per_group)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("k", "place"), F.lit(groups)).cast("int"))
    before = (
        rows.groupBy("shard", "grp").agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("grp")) - F.col("n"))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "grp").orderBy("k", "text_crc32", "size", "place"))
    return (
        rows.withColumn("rank", rank)
        .join(before, ["shard", "grp"])
        .select(
            F.col("k").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - 1).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )
