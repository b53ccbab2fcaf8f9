"""Pseudo-random keys from md5, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *parts: Column | str) -> Column:
    """A hex key; ascending order of it is a random permutation for each seed."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)).cast("binary"))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
