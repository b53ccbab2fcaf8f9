"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, c) for every vertex of edges(a, b): c is the least vertex of its component.

    Each round takes the least label among neighbours, by partial aggregates, then lets
    every label follow its own label. Rounds are written out, so lineage stays short.
    An empty edge table gives an empty result.
    """
    n = edges.count()
    both = edges.select(F.col("a").alias("s"), F.col("b").alias("t"))
    both = written(both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"))), "edges", 2 * n)
    labels = written(both.groupBy("s").agg(F.min("t").alias("m")).select(F.col("s").alias("v"), F.least("s", "m").alias("c")), "labels", n)
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("v").alias("t"), "c"), "t").groupBy(F.col("s").alias("v")).agg(F.min("c").alias("m"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        low = labels.join(near, "v", "left").join(up, "c", "left")
        labels = written(low.select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c"), F.coalesce("up", "c")).alias("c")), "labels", n)
        changed = not labels.filter("c < old").isEmpty()
        labels = labels.select("v", "c")
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
