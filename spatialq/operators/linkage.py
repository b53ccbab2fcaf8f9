"""Average linkage of a few thousand items by rounds of mutual nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def average_linkage(distances: DataFrame) -> DataFrame:
    """(a, b, height, size): the merges of average linkage over distances(a, b, d), one row a pair with a < b.

    A cluster is named by its least item; a merge joins b's cluster into a's, a < b, at the mean distance
    of their items. With average distances two clusters that are nearest to each other stay so whatever
    else is merged, so a round merges all such pairs at once, and the tree is that of merging one pair
    after another. Among equal distances the pair of least names counts as nearer.

    A round is three partial aggregates over the pairs of clusters that are left: the nearest of each
    cluster, the mutual ones, and the sums of distances of what was merged. It halves the clusters at
    best, and always merges the nearest pair of all. The merges, one row an item at most, are kept on
    the driver; the pairs are not.
    """
    kind = dict(distances.dtypes)["a"]
    spark = distances.sparkSession
    n = distances.count()
    one = F.lit(1).cast("bigint")
    pairs = written(distances.select("a", "b", F.col("d").alias("sum"), one.alias("na"), one.alias("nb")), "distances", n)
    done: list[tuple] = []
    while True:
        p = F.struct((F.col("sum") / (F.col("na") * F.col("nb"))).alias("d"), "a", "b", (F.col("na") + F.col("nb")).alias("size"))
        nearest = pairs.select(p.alias("p")).withColumn("c", F.explode(F.array("p.a", "p.b"))).groupBy("c").agg(F.min("p").alias("p"))
        merged = nearest.groupBy("p").agg(F.count("*").alias("k")).filter("k = 2").select("p.a", "p.b", "p.d", "p.size").collect()
        if not merged:  # one cluster is left
            return spark.createDataFrame(done, f"a {kind}, b {kind}, height double, size long")
        done += map(tuple, merged)
        into = [(c, r["a"], r["size"]) for r in merged for c in (r["a"], r["b"])]
        for end in ("a", "b"):
            to = spark.createDataFrame(into, f"{end} {kind}, _to {kind}, _n long")
            size = f"n{end}"
            # at most one row an item
            pairs = pairs.join(F.broadcast(to), end, "left").withColumn(end, F.coalesce("_to", end)).withColumn(size, F.coalesce("_n", size)).drop("_to", "_n")
        low = F.col("a") < F.col("b")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb")]
        left = pairs.filter("a <> b").select(*ends, "sum").groupBy("a", "b", "na", "nb").agg(F.sum("sum").alias("sum"))
        pairs = written(left.select("a", "b", "sum", "na", "nb"), "distances", n)


def leaf_order(merges: DataFrame, items: DataFrame) -> DataFrame:
    """(item, place): the leaves of the tree from left to right, for items(item).

    Clusters are numbered as in the usual table of merges: the items by name, then the merges by height
    (ties by names); of two clusters the lower number is on the left. The tree has one row an item, a
    dimension, and is walked on the driver.
    """
    names = sorted(r[0] for r in items.distinct().collect())
    rows = sorted(merges.collect(), key=lambda r: (r["height"], r["a"], r["b"]))
    number = {name: k for k, name in enumerate(names)}
    leaves = {name: [name] for name in names}
    for k, r in enumerate(rows, len(names)):
        first, second = sorted((r["a"], r["b"]), key=number.__getitem__)
        leaves[r["a"]] = leaves[first] + leaves[second]
        number[r["a"]] = k
    tops = sorted({r["a"] for r in rows} - {r["b"] for r in rows}, key=number.__getitem__) or names
    order = [x for t in tops for x in leaves[t]]
    return items.sparkSession.createDataFrame([(x, k) for k, x in enumerate(order)], f"item {dict(items.dtypes)[items.columns[0]]}, place int")
