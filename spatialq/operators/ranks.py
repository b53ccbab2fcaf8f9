"""Ranks, quantiles and multiple testing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bucket(values: DataFrame, column: str, per_task: int) -> Column | None:
    """A bucket number that rises with the column, each of about per_task rows of values; None where one is enough."""
    n = values.count()
    if n <= per_task:
        return None
    k = -(-n // per_task)
    bounds = sorted(set(values.select(F.percentile_approx(column, [i / k for i in range(1, k)], 10 * k)).first()[0]))
    return bucket_of(bounds, F.col(column))


def bucket_of(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are not above the value, by about 2 sqrt(len(bounds)) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not runs:
        return F.lit(0)

    def upto(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda b: b <= value))

    coarse = upto(F.array(*(F.lit(r[0]) for r in runs)))
    fine = upto(F.get(F.array(*(F.array(*map(F.lit, r)) for r in runs)), F.greatest(coarse - 1, F.lit(0))))
    return F.greatest(coarse - 1, F.lit(0)) * step + fine


def cumulated(counts: DataFrame, value: str, keys: list[str], per_task: int = 200_000) -> DataFrame:
    """counts(keys, value, _c) with _b, a bucket, and _u, the rows up to each value within keys.

    Values are summed in buckets of bounded size, and each bucket is shifted by the rows
    of the lower ones, so no task holds all values of a key.
    """
    bucket = value_bucket(counts, value, per_task)
    counts = counts.withColumn("_b", F.lit(0) if bucket is None else bucket)
    own = counts.withColumn("_u", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value)))
    if bucket is None:
        return own
    n = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    n = n.select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_base"))
    return own.join(n, [*keys, "_b"]).withColumn("_u", F.col("_u") + F.col("_base")).drop("_base")


def with_average_rank(df: DataFrame, value: str, keys: list[str], name: str = "r", per_task: int = 200_000) -> DataFrame:
    """df with the 1-based rank of value within keys; ties share their mean rank, a null value has none.

    Equal values are counted first, so only distinct ones are ranked.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    up = cumulated(counts, value, keys, per_task)
    return df.join(up.select(*keys, value, (F.col("_u") - (F.col("_c") - 1) / F.lit(2.0)).alias(name)), [*keys, value], "left")


def hash_rank(df: DataFrame, keys: list[str], hash_key: Column, *ties: str, rows: int, per_task: int = 200_000) -> DataFrame:
    """df with _r, its 1-based rank within keys by a uniform hex key, without a task that holds a whole group.

    The key's leading bits cut each group into even buckets; buckets are numbered alone
    and shifted by the rows of lower buckets. rows: about how many a group has.
    """
    buckets = max(1, -(-rows // per_task))
    bucket = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") * buckets / F.lit(4294967296.0)).cast("int")
    return bucket_rank(df.withColumn("_h", hash_key), keys, bucket if buckets > 1 else None, ["_h", *ties]).drop("_h")


def id_rank(df: DataFrame, keys: list[str], column: str, rows: int, per_task: int = 200_000) -> DataFrame:
    """df with _r, its 1-based rank within keys by a column, in buckets between approximate quantiles."""
    buckets = max(1, -(-rows // per_task))
    if buckets == 1:
        return bucket_rank(df, keys, None, [column])
    steps = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.select(F.percentile_approx(column, steps, 10 * buckets)).first()[0]))
    return bucket_rank(df, keys, F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))), [column])


def bucket_rank(df: DataFrame, keys: list[str], bucket: Column | None, order: list[str]) -> DataFrame:
    if bucket is None:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    columns = df.columns
    df = df.withColumn("_b", bucket)
    n = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    n = n.withColumn("_base", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return own.join(n, [*keys, "_b"]).select(*columns, (F.col("_base") + F.col("_k")).alias("_r"))


def order_statistics(df: DataFrame, key: str, value: str, places: Callable[[int], list[int]], exact_rows: int = 200_000, bins: int = 1024) -> dict[object, list[float]]:
    """For each key (a few) the values at places(n) of its n sorted values, 1-based and ascending; nulls are left out.

    Large groups narrow the ranges that hold the places by histograms, round by round,
    until few enough values are left to be sorted.
    """
    v = F.col(value)
    first = df.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).collect()
    # one entry for each key and place: key, place, range, values below it, values in it
    state = [(r[0], k, r["lo"], r["hi"], 0, r["n"]) for r in first if r["n"] for k in places(r["n"])]
    kind = f"{key} {dict(df.dtypes)[key]}, _k long, _lo double, _hi double, _below long, _left long"

    def inside() -> DataFrame:
        ranges = df.sparkSession.createDataFrame(state, kind).groupBy(key, "_lo", "_hi").agg(F.min("_below").alias("_below"))
        return df.join(F.broadcast(ranges), key).filter((v >= F.col("_lo")) & (v <= F.col("_hi")))  # a few ranges

    while any(s[5] > exact_rows and s[2] < s[3] for s in state):
        width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
        slot = F.least(F.floor((v - F.col("_lo")) / width * bins), F.lit(bins - 1))
        rows = inside().groupBy(key, "_lo", "_hi", slot.alias("_b")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")).orderBy(key, "_b").collect()
        new = []
        for own, k, lo, hi, below, _ in state:
            for r in (r for r in rows if (r[0], r["_lo"], r["_hi"]) == (own, lo, hi)):
                if below + r["n"] >= k:
                    new.append((own, k, r["lo"], r["hi"], below, r["n"]))
                    break
                below += r["n"]
        state = new
    if not state:
        return {}
    left = inside().groupBy(key, "_lo", "_hi").agg(F.sort_array(F.collect_list(F.when(F.col("_lo") < F.col("_hi"), v))).alias("v")).collect()  # exact_rows at most
    found = {(r[0], r["_lo"], r["_hi"]): r["v"] for r in left}
    out: dict[object, list[float]] = {}
    for own, k, lo, hi, below, _ in state:
        out.setdefault(own, []).append(float(lo if lo == hi else found[own, lo, hi][k - below - 1]))
    return out


def lower_median(df: DataFrame, key: str, value: str, exact_rows: int = 200_000, bins: int = 1024) -> DataFrame:
    """(key, median): the lower of the middle values of each key (a few keys)."""
    found = order_statistics(df, key, value, lambda n: [(n - 1) // 2 + 1], exact_rows, bins)
    return df.sparkSession.createDataFrame([(k, v[0]) for k, v in found.items()], f"{key} {dict(df.dtypes)[key]}, median double")


def quantiles(df: DataFrame, value: str, shares: list[float], exact_rows: int = 200_000) -> list[float]:
    """Quantiles of a column, interpolated between neighbouring values; none of an empty column."""

    def places(n: int) -> list[int]:
        return sorted({k for q in shares for k in (math.floor(q * (n - 1)) + 1, math.ceil(q * (n - 1)) + 1)})

    own = df.select(F.lit(0).alias("_key"), F.col(value).cast("double").alias(value))
    n = own.agg(F.count(value)).first()[0]
    if not n:
        return []
    at = dict(zip(places(n), order_statistics(own, "_key", value, places, exact_rows)[0], strict=True))
    out = []
    for q in shares:
        x = q * (n - 1)
        low, high = at[math.floor(x) + 1], at[math.ceil(x) + 1]
        out.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out


def bh_qvalues(df: DataFrame, p: str = "p_value", keys: tuple[str, ...] = (), per_task: int = 200_000) -> DataFrame:
    """df with q_value: p n / rank, made monotone from the right and clipped to [0, 1].

    Only distinct p-values are ranked, in buckets of bounded size; a bucket's minimum
    goes down to the buckets below it.
    """
    counts = df.groupBy(*keys, p).agg(F.count("*").alias("_c"))
    whole = counts.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    up = cumulated(counts, p, list(keys), per_task)
    q = (up.join(whole, list(keys)) if keys else up.crossJoin(F.broadcast(whole))).withColumn("_q", F.col(p) * F.col("_t") / F.col("_u"))
    least = q.groupBy(*keys, "_b").agg(F.min("_q").alias("_m"))
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, "_b", F.min("_m").over(later).alias("_m"))
    q = q.join(least, [*keys, "_b"])
    low = F.least(F.min("_q").over(Window.partitionBy(*keys, "_b").orderBy(F.col(p).desc())), "_m")
    q = q.select(*keys, p, F.least(F.lit(1.0), F.greatest(F.lit(0.0), low)).alias("q_value"))
    return df.join(q, [*keys, p])


def quantile_bins(df: DataFrame, x: str, y: str, n: int, least: int) -> DataFrame:
    """(bin, mean_x, mean_y, n) over distinct quantile edges of x; bins with at least so many rows."""
    edges = list(dict.fromkeys(quantiles(df, x, [i / n for i in range(n + 1)])))
    inner = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x)))
    slot = F.least(F.greatest(inner - 1, F.lit(0)), F.lit(max(len(edges) - 2, 0)))
    return df.groupBy(slot.alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count("*").alias("n")).filter(F.col("n") >= least)


def size_order(df: DataFrame, label: str) -> DataFrame:
    """Labels by count, largest first; ties by label."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), label)))


def best_per(df: DataFrame, keys: list[str], value: Column, *ties: str) -> DataFrame:
    """The row of least value for each key; ties by the given columns. A partial aggregate, no group is sorted."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(value.alias("v"), *ties)).alias("_row"))
    return best.select("_row.*")


def rank_match(values: DataFrame, reference: DataFrame, keys: list[str], per_task: int = 200_000) -> DataFrame:
    """values dealt to the cells so that their order is the reference's, within keys; ties by cell_id."""

    def ranked(df: DataFrame) -> DataFrame:
        return bucket_rank(df.select(*keys, "cell_id", "value"), keys, value_bucket(df, "value", per_task), ["value", "cell_id"])

    a = ranked(values).select(*keys, "value", "_r")
    return ranked(reference).select(*keys, "cell_id", "_r").join(a, [*keys, "_r"]).select(*keys, "cell_id", "value")


def jaccard(sets: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, jaccard) for all pairs of keys (a few): shared items over all items."""
    s = sets.groupBy(key).agg(F.collect_set(item).alias("s"))
    a, b = s.select(F.col(key).alias("a"), F.col("s").alias("sa")), s.select(F.col(key).alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (both / F.size(F.array_union("sa", "sb"))).alias("jaccard"))
