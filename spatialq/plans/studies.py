"""Study grids and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.portable import order_key
from ..operators import ranks as RK
from ..operators import studies as ST
from . import sqltext as S
from .registry import near, query


@query("""SELECT condition, truth, seed FROM (SELECT DISTINCT o_orderpriority AS condition FROM orders), (SELECT DISTINCT o_orderstatus AS truth FROM orders), (SELECT unnest(generate_series(0, 4)) AS seed)""")
def expand_grid(spark, d):
    """The runs of a study: every condition and truth that occurs, with five seeds."""
    rows = B.study_rows(spark, d)
    seen = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in ("condition", "truth")}  # dimensions
    return ST.grid(spark, seen | {"seed": list(range(5))})


@query(near("rate se lo hi", f"""WITH {S.STUDY}, a AS (SELECT condition, truth, count(*) AS n, count(*) FILTER (p_value < 0.05) AS n_reject FROM study GROUP BY 1, 2), r AS (SELECT *, n_reject / n::DOUBLE AS rate FROM a), s AS (SELECT *, sqrt(rate * (1 - rate) / n) AS se FROM r)
SELECT *, greatest(0, rate - 1.96 * se) AS lo, least(1, rate + 1.96 * se) AS hi, CASE WHEN truth = 'F' THEN 'power' ELSE 'null_rejection_rate' END AS label FROM s"""))
def study_rates(spark, d):
    return ST.rates(B.study_rows(spark, d), ["condition", "truth"], 0.05).withColumn("label", F.when(F.col("truth") == "F", "power").otherwise("null_rejection_rate"))


@query(near("mean_p std_p min_p max_p mean_stat", f"WITH {S.STUDY} SELECT condition, avg(p_value) AS mean_p, stddev_pop(p_value) AS std_p, min(p_value) AS min_p, max(p_value) AS max_p, avg(stat) AS mean_stat FROM study GROUP BY 1"))
def study_pvalue_summary(spark, d):
    return ST.p_summary(B.study_rows(spark, d), ["condition"])


@query(near("rate median_p mean_p", f"WITH {S.STUDY} SELECT condition, truth, count(*) AS n, count(*) FILTER (p_value <= 0.05) AS n_reject, count(*) FILTER (p_value <= 0.05) / count(*)::DOUBLE AS rate, quantile_cont(p_value, 0.5) AS median_p, avg(p_value) AS mean_p FROM study GROUP BY 1, 2"))
def kernel_study_summary(spark, d):
    return ST.kernel_summary(B.study_rows(spark, d), ["condition", "truth"], 0.05)


@query(near("median mean top_rank_rate zlike", f"""WITH {S.STUDY}, m AS (SELECT condition, truth, CASE WHEN run_id % 11 = 0 THEN NULL ELSE stat END AS stat FROM study)
SELECT condition, quantile_cont(stat, 0.5) AS median, avg(stat) AS mean, avg(CASE WHEN stat >= 150000 THEN 1e0 ELSE 0 END) AS top_rank_rate, (max(stat) - avg(stat)) / (stddev_pop(stat) + 1e-12) AS zlike FROM m GROUP BY 1"""))
def moran_study_summary(spark, d):
    """Medians and means that leave missing statistics out."""
    m = B.study_rows(spark, d).withColumn("stat", F.when(F.col("run_id") % 11 != 0, F.col("stat")))
    return m.groupBy("condition").agg(
        F.percentile("stat", F.lit(0.5)).alias("median"), F.avg("stat").alias("mean"),
        F.avg(F.when(F.col("stat") >= 150000, 1.0).otherwise(0.0)).alias("top_rank_rate"), ((F.max("stat") - F.avg("stat")) / (F.stddev_pop("stat") + 1e-12)).alias("zlike"),
    )


@query(near("sig_rate", f"WITH {S.STUDY} SELECT truth, count(*) AS n_regions, count(*) FILTER (p_value < 0.05) / count(*)::DOUBLE AS sig_rate FROM study GROUP BY 1"))
def region_sig_rate(spark, d):
    return B.study_rows(spark, d).groupBy("truth").agg(F.count("*").alias("n_regions"), (F.count_if(F.col("p_value") < 0.05) / F.count("*")).alias("sig_rate"))


@query(near("F O P", f"WITH {S.STUDY} SELECT condition, arg_min(p_value, run_id) FILTER (truth = 'F') AS F, arg_min(p_value, run_id) FILTER (truth = 'O') AS O, arg_min(p_value, run_id) FILTER (truth = 'P') AS P FROM study GROUP BY 1"))
def pvalue_pivot(spark, d):
    return B.study_rows(spark, d).groupBy("condition").pivot("truth", ["F", "O", "P"]).agg(F.min_by("p_value", "run_id"))


@query(near("percentile", f"""WITH {S.STUDY}, t AS (SELECT condition, min_by(stat, run_id) AS t FROM study GROUP BY 1)
SELECT condition, count(*) FILTER (stat <= t AND run_id <> f) + 1 AS rank, count(*) FILTER (stat <= t AND run_id <> f) / (count(*) - 1)::DOUBLE AS percentile FROM study JOIN t USING (condition) JOIN (SELECT condition, min(run_id) AS f FROM study GROUP BY 1) USING (condition) GROUP BY 1"""))
def target_rank(spark, d):
    """Rank of the first run of each condition among the others."""
    s = B.study_rows(spark, d)
    t = s.groupBy("condition").agg(F.min_by("stat", "run_id").alias("t"), F.min("run_id").alias("f"))
    better = F.count_if((F.col("stat") <= F.col("t")) & (F.col("run_id") != F.col("f")))
    return s.join(F.broadcast(t), "condition").groupBy("condition").agg((better + 1).alias("rank"), (better / (F.count("*") - 1)).alias("percentile"))


@query(near("loss", f"WITH {S.STUDY}, f AS (SELECT condition, run_id % 5 AS fold, count(*) AS n, avg(stat) AS l FROM study GROUP BY 1, 2) SELECT condition, sum(n * l) / sum(n) AS loss FROM f GROUP BY 1"))
def cv_weighted_loss(spark, d):
    folds = B.study_rows(spark, d).groupBy("condition", (F.col("run_id") % 5).alias("fold")).agg(F.count("*").alias("n"), F.avg("stat").alias("loss"))
    return ST.weighted_loss(folds, ["condition"])


@query(near("stat_true p_value", f"WITH {S.STUDY}, c AS (SELECT condition, truth, min(stat) AS s, avg(p_value) AS p, count(*) AS n FROM study GROUP BY 1, 2) SELECT condition, avg(s) AS stat_true, avg(p) AS p_value, sum(n)::BIGINT AS n_nulls FROM c GROUP BY 1"))
def separate_combine(spark, d):
    """Results by cell type combined: mean statistics, mean p-values, nulls side by side."""
    c = B.study_rows(spark, d).groupBy("condition", "truth").agg(F.min("stat").alias("s"), F.avg("p_value").alias("p"), F.count("*").alias("n"))
    return c.groupBy("condition").agg(F.avg("s").alias("stat_true"), F.avg("p").alias("p_value"), F.sum("n").alias("n_nulls"))


@query(near("stat", f"WITH {S.STUDY} SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY run_id) - 1 AS slot, stat FROM study"))
def explode_nulls(spark, d):
    """Every statistic with its place among its condition's, in buckets of bounded size."""
    s = B.study_rows(spark, d).select("condition", "run_id", "stat")
    return RK.id_rank(s, ["condition"], "run_id", s.count()).select("condition", (F.col("_r") - 1).cast("bigint").alias("slot"), "stat")


@query(near("mean std p5 p95", f"""WITH {S.STUDY}, l AS (SELECT run_id, stat FROM study), d AS (SELECT draw, stat, row_number() OVER (PARTITION BY draw ORDER BY {S.key(2, 'draw', 'run_id')}, run_id) AS r FROM l, (SELECT unnest(generate_series(1, 40)) AS draw)),
m AS (SELECT k, draw, min(stat) AS b FROM d JOIN (SELECT unnest([1, 3, 10]) AS k) ON r <= k GROUP BY 1, 2)
SELECT k, avg(b) AS mean, stddev_pop(b) AS std, quantile_cont(b, 0.05) AS p5, quantile_cont(b, 0.95) AS p95 FROM m GROUP BY 1"""))
def best_of_k(spark, d):
    return ST.best_of_k(B.study_rows(spark, d).select("run_id", "stat"), [1, 3, 10], 40, 2)


@query("SELECT c_custkey AS run_id, o_orderkey AS result, CASE WHEN o_orderkey IS NULL THEN 'MISSING' ELSE 'ok' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = 0")
def study_manifest_join(spark, d):
    m = B.read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    r = B.read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("result"))
    return ST.with_status(m, r, ["run_id"], "result")


@query(f"WITH {S.STUDY}, u AS (SELECT run_id, condition AS path, 0 AS pri FROM study WHERE run_id % 2 = 0 UNION ALL SELECT run_id, truth, 1 FROM study) SELECT run_id, path FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pri) AS r FROM u) WHERE r = 1")
def manifest_precedence(spark, d):
    """Paths of the manifest first, scanned ones where it has none."""
    s = B.study_rows(spark, d)
    return ST.first_of(s.filter("run_id % 2 = 0").select("run_id", F.col("condition").alias("path")), s.select("run_id", F.col("truth").alias("path")), ["run_id"])


@query(near("effect_z", f"WITH {S.STUDY}, a AS (SELECT condition, avg(stat) AS m, stddev_pop(stat) AS s, min_by(stat, run_id) AS t FROM study GROUP BY 1) SELECT condition, (m - t) / (s + 1e-12) AS effect_z FROM a"))
def effect_z(spark, d):
    a = B.study_rows(spark, d).groupBy("condition").agg(F.avg("stat").alias("m"), F.stddev_pop("stat").alias("s"), F.min_by("stat", "run_id").alias("t"))
    return a.select("condition", ((F.col("m") - F.col("t")) / (F.col("s") + 1e-12)).alias("effect_z"))


@query(near("p_value", f"""WITH {S.STUDY}, e AS (SELECT condition, run_id % 40 AS slot, run_id % 3 AS rerun, run_id % 10 AS epoch, min(stat) AS loss FROM study GROUP BY 1, 2, 3, 4), l AS (SELECT condition, slot, max(epoch) AS last FROM e GROUP BY 1, 2),
w AS (SELECT condition, slot, rerun FROM (SELECT e.condition, e.slot, rerun, row_number() OVER (PARTITION BY e.condition, e.slot ORDER BY loss, rerun) AS r FROM e JOIN l ON l.condition = e.condition AND l.slot = e.slot AND e.epoch = l.last) WHERE r = 1),
b AS (SELECT condition, slot, epoch, loss FROM e JOIN w USING (condition, slot, rerun)), t AS (SELECT condition, epoch, loss AS t FROM b WHERE slot = 0)
SELECT condition, epoch, (count(*) FILTER (loss <= t) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM b JOIN t USING (condition, epoch) WHERE slot > 0 GROUP BY 1, 2"""))
def pvalue_trajectory(spark, d):
    """p-values by epoch, each slot by the rerun that wins at its last epoch."""
    s = B.study_rows(spark, d)
    e = s.groupBy("condition", (F.col("run_id") % 40).alias("slot"), (F.col("run_id") % 3).alias("rerun"), (F.col("run_id") % 10).alias("epoch")).agg(F.min("stat").alias("loss"))
    return ST.p_trajectory(e, ["condition"])


@query(f"WITH {S.STUDY} SELECT o.run_id, {S.key(6, 'o.run_id')} AS k FROM study o ORDER BY k, run_id LIMIT 25")
def repeats_sample(spark, d):
    """A hash-ordered sample of runs to repeat."""
    return B.study_rows(spark, d).select("run_id", order_key(6, "run_id").alias("k")).orderBy("k", "run_id").limit(25)


@query(f"WITH {S.STUDY}, c AS (SELECT condition, floor(p_value * 20) AS bin, count(*) AS n FROM study GROUP BY 1, 2) SELECT condition, CAST(bin AS BIGINT) AS bin, n, sum(n) OVER (PARTITION BY condition ORDER BY bin)::BIGINT AS below FROM c")
def pvalue_histogram(spark, d):
    """Histogram and running counts of p-values: the data of an ECDF."""
    c = B.study_rows(spark, d).groupBy("condition", F.floor(F.col("p_value") * 20).alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("below", F.sum("n").over(Window.partitionBy("condition").orderBy("bin")))
