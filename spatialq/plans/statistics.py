"""Ranks, metrics, scores and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import decoders as D
from ..operators import expr as E
from ..operators import metrics as M
from ..operators import ranks as RK
from . import sqltext as S
from .registry import near, query


@query(near("r", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS r FROM lineitem"))
def avg_rank(spark, d):
    items = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return RK.with_average_rank(items, "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "r")


@query(near("p_value q_value", f"""WITH {S.STUDY}, r AS (SELECT run_id, p_value, row_number() OVER (ORDER BY p_value, run_id) AS r, count(*) OVER () AS n FROM study)
SELECT run_id, p_value, least(1, greatest(0, min(p_value * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS q_value FROM r"""))
def bh_qvalues(spark, d):
    return RK.bh_qvalues(B.study_rows(spark, d)).select("run_id", "p_value", "q_value")


@query(near("mean_x mean_y", """WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM customer),
b AS (SELECT least(greatest(len(list_filter(e, lambda v: v <= c_acctbal)) - 1, 0), len(e) - 2) AS bin, c_acctbal, c_nationkey FROM customer, e)
SELECT CAST(bin AS INTEGER) AS bin, avg(c_acctbal) AS mean_x, avg(c_nationkey) AS mean_y, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 5"""))
def quantile_bins(spark, d):
    return RK.quantile_bins(B.read(spark, d, "customer"), "c_acctbal", "c_nationkey", 10, 5)


@query("SELECT cell_type, n, row_number() OVER (ORDER BY n DESC, cell_type) AS place FROM (SELECT c_mktsegment AS cell_type, count(*) AS n FROM customer GROUP BY 1)")
def celltype_order(spark, d):
    return RK.size_order(B.count_cells(spark, d), "cell_type")


CORR = "CASE WHEN var_pop({a}) * var_pop({b}) <= 1e-24 THEN 0 ELSE covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) END"


@query(near("rho", f"WITH {S.dense()}, r AS (SELECT gene, {CORR.format(a='x', b='value')} AS rho FROM expr JOIN cells USING (cell_id) GROUP BY 1) SELECT * FROM (SELECT gene, rho FROM r ORDER BY round(abs(rho), 9) DESC, gene LIMIT 10)"))
def top_genes(spark, d):
    r = B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id").groupBy("gene").agg(M.pearson("x", "value").alias("rho"))
    return r.orderBy(F.round(F.abs("rho"), 9).desc(), "gene").limit(10)


@query(near("jaccard", f"WITH {S.SETS} SELECT a.pathway AS a, b.pathway AS b, (SELECT count(*) FROM sets x JOIN sets y ON x.gene = y.gene WHERE x.pathway = a.pathway AND y.pathway = b.pathway) / ((SELECT count(DISTINCT gene) FROM sets x WHERE x.pathway IN (a.pathway, b.pathway)))::DOUBLE AS jaccard FROM (SELECT DISTINCT pathway FROM sets) a JOIN (SELECT DISTINCT pathway FROM sets) b ON a.pathway < b.pathway"))
def jaccard_topk(spark, d):
    return RK.jaccard(B.gene_sets(spark, d), "pathway", "gene")


@query(f"WITH {S.STUDY} SELECT condition, arg_min(run_id, (stat, run_id)) AS lowest, arg_max(run_id, (stat, -run_id)) AS highest FROM study GROUP BY 1")
def null_extremes(spark, d):
    s = B.study_rows(spark, d)
    return s.groupBy("condition").agg(F.min_by("run_id", F.struct("stat", "run_id")).alias("lowest"), F.max_by("run_id", F.struct("stat", -F.col("run_id"))).alias("highest"))


@query(near("stat", f"WITH {S.STUDY} SELECT condition, truth, run_id, stat FROM (SELECT *, row_number() OVER (PARTITION BY condition, truth ORDER BY stat, run_id) AS r FROM study) WHERE r = 1"))
def best_rerun(spark, d):
    """The least loss of each slot, first on ties."""
    return RK.best_per(B.study_rows(spark, d), ["condition", "truth"], F.col("stat"), "run_id").select("condition", "truth", "run_id", "stat")


@query(near("score", "SELECT gene, score, p_partkey FROM (SELECT p_brand AS gene, p_retailprice - 1400 AS score, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(p_retailprice - 1400), 6) DESC, p_partkey) AS r FROM part) WHERE r = 1"))
def collapse_genes(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_brand").alias("gene"), (F.col("p_retailprice") - 1400).alias("score"), "p_partkey")
    return RK.best_per(p, ["gene"], -F.round(F.abs("score"), 6), "p_partkey")


@query(near("value", f"""WITH {S.dense()}, v AS (SELECT cell_id, gene, value * value AS value FROM expr),
a AS (SELECT gene, value, row_number() OVER (PARTITION BY gene ORDER BY value, cell_id) AS r FROM v), b AS (SELECT gene, cell_id, row_number() OVER (PARTITION BY gene ORDER BY value, cell_id) AS r FROM expr)
SELECT gene, cell_id, a.value FROM a JOIN b USING (gene, r)"""))
def rank_match(spark, d):
    e = B.dense_expr(spark, d)
    return RK.rank_match(e.withColumn("value", F.col("value") * F.col("value")), e, ["gene"])


@query(near("z", f"WITH {S.dense(1)}, o AS (SELECT corr(x, value) AS r FROM expr JOIN cells USING (cell_id)) SELECT cell_id, CASE WHEN r < 0 THEN -value ELSE value END AS z FROM expr, o"))
def orient_sign(spark, d):
    """An axis flipped so that it correlates positively with its reference."""
    e = B.dense_expr(spark, d, 1)
    r = e.join(B.dense_cells(spark, d), "cell_id").agg(M.pearson("x", "value").alias("_r"))
    return e.crossJoin(F.broadcast(r)).select("cell_id", F.when(F.col("_r") < 0, -F.col("value")).otherwise(F.col("value")).alias("z"))


FIT = "f AS (SELECT gene, value, x AS z, regr_slope(value, x) OVER (PARTITION BY gene) * x + regr_intercept(value, x) OVER (PARTITION BY gene) AS predicted, cell_id FROM expr JOIN cells USING (cell_id))"


def fitted(spark, d):
    """Rows (gene, cell_id, value, predicted) of the linear decoder on x."""
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    fit = D.linear_fit(D.linear_sums(rows, ["gene"])).select("gene", "slope", "intercept")
    return rows.join(F.broadcast(fit), "gene").withColumn("predicted", F.col("slope") * F.col("z") + F.col("intercept"))


@query(near("mse", f"WITH {S.dense()}, {FIT} SELECT gene, avg((predicted - value) ** 2) AS mse FROM f GROUP BY 1"))
def metric_mse(spark, d):
    return M.losses(fitted(spark, d), ["gene"]).select("gene", "mse")


@query(near("nll_gaussian", f"WITH {S.dense()}, {FIT} SELECT gene, count(*) / 2e0 * ln(2 * pi() * avg((predicted - value) ** 2) + 1e-12) + count(*) / 2e0 AS nll_gaussian FROM f GROUP BY 1"))
def metric_nll_gaussian(spark, d):
    return M.losses(fitted(spark, d), ["gene"]).select("gene", "nll_gaussian")


@query(near("nll_poisson", f"""WITH {S.COUNTS}, {S.GRID}, t AS (SELECT cell_id, sum(value) AS factor FROM dense GROUP BY 1), m AS (SELECT gene, ln(sum(value) / (SELECT sum(value) FROM dense)) AS eta FROM dense GROUP BY 1)
SELECT gene, avg(factor * exp(eta) - value * eta) AS nll_poisson FROM dense JOIN t USING (cell_id) JOIN m USING (gene) GROUP BY 1"""))
def metric_nll_poisson(spark, d):
    """Poisson loss of the genes' constant shares, with cell totals as size factors."""
    e = E.densify(B.count_cells(spark, d), B.count_expr(spark, d))
    total = e.groupBy("cell_id").agg(F.sum("value").alias("factor"))
    by = e.groupBy("gene").agg(F.sum("value").alias("g"))
    whole = by.agg(F.sum("g").alias("w"))
    eta = by.crossJoin(F.broadcast(whole)).select("gene", F.log(F.col("g") / F.col("w")).alias("eta"))
    return M.nll_poisson(e.join(total, "cell_id").join(F.broadcast(eta), "gene"), ["gene"])


@query(near("r", f"WITH {S.dense()}, c AS (SELECT gene, {CORR.format(a='x', b='value')} AS r FROM expr JOIN cells USING (cell_id) GROUP BY 1) SELECT avg(r) AS r FROM c"))
def metric_pearson(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id").withColumn("predicted", F.col("x"))
    return M.correlation(rows, [])


RANKS = "rank() OVER (PARTITION BY gene ORDER BY {c}) + (count(*) OVER (PARTITION BY gene, {c}) - 1) / 2e0"


@query(near("r", f"WITH {S.dense()}, k AS (SELECT gene, {RANKS.format(c='x')} AS a, {RANKS.format(c='value')} AS b FROM expr JOIN cells USING (cell_id)), c AS (SELECT gene, {CORR.format(a='a', b='b')} AS r FROM k GROUP BY 1) SELECT avg(r) AS r FROM c"))
def metric_spearman(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id")
    ranked = M.rank_columns(rows, ["gene"], ["x", "value"])
    return M.correlation(ranked.withColumn("predicted", F.col("x")), [])


@query(near("mse", f"WITH {S.dense()}, {FIT} SELECT gene, avg((predicted - value) ** 2) AS mse FROM f WHERE cell_id % 3 = 0 GROUP BY 1"))
def metric_masked(spark, d):
    mask = B.dense_cells(spark, d).filter("cell_id % 3 = 0").select("cell_id")
    return M.masked_losses(fitted(spark, d), mask, ["gene"]).select("gene", "mse")


@query(near("stat_true p_value", f"""WITH {S.STUDY}, t AS (SELECT condition, run_id % 200 AS slot, min(stat) AS stat FROM study GROUP BY 1, 2), z AS (SELECT condition, stat AS stat_true FROM t WHERE slot = 0)
SELECT condition, stat_true, (count(*) FILTER (stat <= stat_true) + 1) / (count(*) + 1)::DOUBLE AS p_value, count(*) AS n_perms FROM t JOIN z USING (condition) WHERE slot > 0 GROUP BY 1, 2"""))
def perm_pvalue(spark, d):
    s = B.study_rows(spark, d).groupBy("condition", (F.col("run_id") % 200).alias("slot")).agg(F.min("stat").alias("stat"))
    return M.permutation_p(s, ["condition"])


@query(near("mse spearman", f"""WITH {S.dense(2)}, a AS (SELECT cell_id, max(CASE WHEN gene = 'g02' THEN value END) AS a, max(CASE WHEN gene = 'g03' THEN value END) AS b FROM expr GROUP BY 1),
n AS (SELECT (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER () + 1e-8) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER () + 1e-8) AS b FROM a),
k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM n)
SELECT avg((a - b) ** 2) AS mse, abs({CORR.format(a='ra', b='rb')}) AS spearman FROM k"""))
def depth_similarity(spark, d):
    """Two depth axes scaled to [0, 1]: mean square difference and absolute rank correlation."""
    e = B.dense_expr(spark, d, 2)
    wide = e.groupBy("cell_id").pivot("gene", ["g02", "g03"]).agg(F.first("value")).withColumnsRenamed({"g02": "a", "g03": "b"})
    s = wide.agg(*(f(c).alias(f"_{n}{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))))
    n = wide.crossJoin(F.broadcast(s)).select(*(M.minmax(F.col(c), F.col(f"_lo{c}"), F.col(f"_hi{c}")).alias(c) for c in "ab"))
    k = RK.with_average_rank(RK.with_average_rank(n, "a", [], "ra"), "b", [], "rb")
    return k.agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"), F.abs(M.pearson("ra", "rb")).alias("spearman"))


@query(near("r2", f"WITH {S.dense()} SELECT gene, regr_r2(value, x) AS r2 FROM expr JOIN cells USING (cell_id) GROUP BY 1"))
def ols_r2(spark, d):
    return B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id").groupBy("gene").agg(F.regr_r2("value", "x").alias("r2"))


@query(near("r", f"WITH {S.dense()} SELECT a.gene AS a, b.gene AS b, corr(a.value, b.value) AS r FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene < b.gene GROUP BY 1, 2"))
def gene_corr(spark, d):
    """All pairs of genes, cells being the join key: the pairs are a small square, the cells may be many."""
    a = B.dense_expr(spark, d).select("cell_id", F.col("gene").alias("a"), F.col("value").alias("va"))
    b = a.select("cell_id", F.col("a").alias("b"), F.col("va").alias("vb"))
    return a.join(b, "cell_id").filter("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"))


@query(near("r", f"WITH {S.dense()}, k AS (SELECT cell_id, gene, {RANKS.format(c='value')} AS k FROM expr) SELECT a.gene AS a, b.gene AS b, corr(a.k, b.k) AS r FROM k a JOIN k b ON a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY 1, 2"))
def spearman_matrix(spark, d):
    k = RK.with_average_rank(B.dense_expr(spark, d), "value", ["gene"], "ka").select("cell_id", F.col("gene").alias("a"), "ka")
    b = k.select("cell_id", F.col("a").alias("b"), F.col("ka").alias("kb"))
    return k.join(b, "cell_id").filter("a <= b").groupBy("a", "b").agg(F.corr("ka", "kb").alias("r"))


@query(near("score", f"WITH {S.COUNTS}, {S.GRID}, {S.SETS} SELECT cell_id, pathway, avg(value) AS score FROM dense JOIN sets USING (gene) GROUP BY 1, 2"))
def pathway_score(spark, d):
    """Mean measurement of a pathway's genes by cell; for sparse counts the sum over set size, so nothing is made dense."""
    sets = B.gene_sets(spark, d)
    e = B.count_expr(spark, d)
    known = sets.join(e.select("gene").distinct(), "gene", "left_semi")
    size = known.groupBy("pathway").agg(F.count("*").alias("n"))
    cells = B.count_cells(spark, d).select("cell_id")
    sums = e.join(F.broadcast(known), "gene").groupBy("cell_id", "pathway").agg(F.sum("value").alias("s"))
    grid = cells.crossJoin(F.broadcast(size))
    return grid.join(sums, ["cell_id", "pathway"], "left").select("cell_id", "pathway", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("score"))


@query(near("detection mean_value", f"""WITH {S.COUNTS}, n AS (SELECT count(*)::DOUBLE AS n FROM cells), {S.SETS},
g AS (SELECT gene, count(*) FILTER (value > 0) AS seen, sum(value) AS total FROM expr GROUP BY 1)
SELECT pathway, count(*) AS n_genes, count(*) FILTER (seen >= n * 0.6) AS n_supported, avg(seen / n) AS detection, avg(total / n) AS mean_value FROM sets JOIN g USING (gene), n GROUP BY 1"""))
def pathway_power(spark, d):
    n = float(B.count_cells(spark, d).count())
    g = B.count_expr(spark, d).groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("seen"), F.sum("value").alias("total"))
    return B.gene_sets(spark, d).join(g, "gene").groupBy("pathway").agg(
        F.count("*").alias("n_genes"), F.count_if(F.col("seen") >= n * 0.6).alias("n_supported"), F.avg(F.col("seen") / n).alias("detection"), F.avg(F.col("total") / n).alias("mean_value")
    )


@query(near("mean std min max median", f"WITH {S.STUDY} SELECT condition, avg(stat) AS mean, stddev_pop(stat) AS std, min(stat) AS min, max(stat) AS max, quantile_cont(stat, 0.5) AS median FROM study GROUP BY 1"))
def metric_summary(spark, d):
    return M.summary(B.study_rows(spark, d), ["condition"], "stat")


@query(near("decoder pearson", f"""WITH {S.dense()} SELECT gene, regr_slope(value, x) * greatest(corr(x, value), 0) AS decoder, corr(x, value) AS pearson FROM expr JOIN cells USING (cell_id) GROUP BY 1"""))
def gene_scores(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id")
    return rows.groupBy("gene").agg((F.regr_slope("value", "x") * F.greatest(F.corr("x", "value"), F.lit(0.0))).alias("decoder"), F.corr("x", "value").alias("pearson"))




GSEA = """r AS (SELECT gene, score, row_number() OVER (ORDER BY round(score, 9) DESC, gene) AS rank FROM (SELECT p_brand AS gene, avg(p_retailprice) - (SELECT avg(p_retailprice) FROM part) AS score FROM part GROUP BY 1)),
h AS (SELECT s.pathway, r.gene, r.rank, abs(score) AS w, sets.gene IS NOT NULL AS hit FROM (SELECT DISTINCT pathway FROM sets) s CROSS JOIN r LEFT JOIN sets ON sets.pathway = s.pathway AND sets.gene = r.gene)"""


@query(near("es", f"""WITH sets AS (SELECT pathway, gene FROM (SELECT p_type AS pathway, p_brand AS gene, count(*) AS n, rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1, 2) WHERE k <= 8), {GSEA},
t AS (SELECT pathway, gene, rank, sum(CASE WHEN hit THEN w / nh ELSE -1e0 / nm END) OVER (PARTITION BY pathway ORDER BY rank) AS run FROM (SELECT *, sum(CASE WHEN hit THEN w ELSE 0 END) OVER (PARTITION BY pathway) AS nh, count(*) FILTER (NOT hit) OVER (PARTITION BY pathway) AS nm FROM h))
SELECT pathway, CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END AS es FROM t GROUP BY 1"""))
def gsea_es(spark, d):
    from ..operators import gsea

    return gsea.enrichment(*gsea_inputs(spark, d)).select("pathway", "es")


def gsea_inputs(spark, d):
    p = B.read(spark, d, "part")
    mean = p.agg(F.avg("p_retailprice").alias("_m"))
    ranking = p.groupBy(F.col("p_brand").alias("gene")).agg(F.avg("p_retailprice").alias("s")).crossJoin(F.broadcast(mean)).select("gene", (F.col("s") - F.col("_m")).alias("score"))
    n = p.groupBy(F.col("p_type").alias("pathway"), F.col("p_brand").alias("gene")).agg(F.count("*").alias("n"))
    k = n.withColumn("_k", F.rank().over(Window.partitionBy("pathway").orderBy(F.col("n").desc(), "gene")))
    return ranking, k.filter("_k <= 8").select("pathway", "gene")


GSEA_NULLS = f"""WITH sets AS (SELECT pathway, gene FROM (SELECT p_type AS pathway, p_brand AS gene, count(*) AS n, rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1, 2) WHERE k <= 8), {GSEA},
many AS (SELECT slot, gene, score FROM r, (SELECT unnest(generate_series(1, 100)) AS slot)),
deal AS (SELECT slot, gene, row_number() OVER (PARTITION BY slot ORDER BY {S.key(5, 'slot', 'gene')}, gene) AS k FROM many),
own AS (SELECT slot, score, row_number() OVER (PARTITION BY slot ORDER BY gene) AS k FROM many),
a AS (SELECT 0 AS slot, gene, score FROM r UNION ALL SELECT slot, gene, score FROM own JOIN deal USING (slot, k)),
ar AS (SELECT slot, gene, abs(score) AS w, row_number() OVER (PARTITION BY slot ORDER BY round(score, 9) DESC, gene) AS rank FROM a),
ah AS (SELECT slot, p.pathway, ar.gene, rank, w, sets.gene IS NOT NULL AS hit FROM ar CROSS JOIN (SELECT DISTINCT pathway FROM sets) p LEFT JOIN sets ON sets.pathway = p.pathway AND sets.gene = ar.gene),
at_ AS (SELECT *, sum(CASE WHEN hit THEN w / nh ELSE -1e0 / nm END) OVER (PARTITION BY slot, pathway ORDER BY rank) AS run
  FROM (SELECT *, sum(CASE WHEN hit THEN w ELSE 0 END) OVER (PARTITION BY slot, pathway) AS nh, count(*) FILTER (NOT hit) OVER (PARTITION BY slot, pathway) AS nm FROM ah)),
es AS (SELECT slot, pathway, count_if(hit) AS size, CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END AS es FROM at_ GROUP BY 1, 2),
both_ AS (SELECT t.pathway, t.size, t.es, n.es AS e0, (t.es >= 0) = (n.es >= 0) AS same FROM es t JOIN es n USING (pathway) WHERE t.slot = 0 AND n.slot > 0 AND t.size BETWEEN 3 AND 500),
p AS (SELECT pathway, size, es, es / avg(abs(e0)) FILTER (same) AS nes, (count(*) FILTER (same AND abs(e0) >= abs(es)) + 1) / (count(*) FILTER (same) + 1) AS p_value FROM both_ GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (ORDER BY p_value, pathway) AS k, count(*) OVER () AS n FROM p)
SELECT pathway, CAST(size AS BIGINT) AS size, es, nes, p_value, least(1, min(p_value * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM k"""


@query(near("es nes p_value q_value", GSEA_NULLS))
def gsea(spark, d):
    """Preranked enrichment with gene-label permutations: es, nes, p and q by pathway."""
    from ..operators import gsea as G

    return G.preranked(*gsea_inputs(spark, d), n_perms=100, seed=5)


@query(near("ratio", f"""WITH {S.dense()}, s AS (SELECT gene, cell_type, regr_sxx(x, value) AS sxx, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, regr_sxx(value, x) AS sx FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2),
r AS (SELECT gene, sum(syy) AS a, sum(syy - sxy * sxy / sx) AS b FROM s GROUP BY 1)
SELECT gene, a / b AS ratio, row_number() OVER (ORDER BY round(a / b, 9) DESC NULLS LAST, gene) AS place FROM r"""))
def rss_ratio(spark, d):
    """Residual sums of squares of type means over those of lines within types, ranked."""
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", "cell_type", F.col("x").alias("z")), "cell_id")
    fit = D.linear_fit(D.linear_sums(rows, ["gene", "cell_type"])).groupBy("gene").agg(F.sum("sst").alias("a"), F.sum("sse").alias("b"))
    r = fit.select("gene", F.try_divide("a", "b").alias("ratio"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.round("ratio", 9).desc_nulls_last(), "gene")))


def gene_distances(spark, d):
    """(a, b, d): one less the size of the correlation, for all pairs of genes."""
    return gene_corr(spark, d).select("a", "b", (1 - F.abs("r")).alias("d"))


@query(near("height", f"""WITH RECURSIVE {S.dense()}, dist AS MATERIALIZED (SELECT a.gene AS a, b.gene AS b, 1 - abs(corr(a.value, b.value)) AS d FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene <> b.gene GROUP BY 1, 2),
t AS (SELECT 0 AS step, gene, gene AS c, NULL::DOUBLE AS height, NULL::VARCHAR AS ma, NULL::VARCHAR AS mb FROM (SELECT DISTINCT gene FROM expr)
  UNION ALL
  SELECT step + 1, gene, CASE WHEN c = m.b THEN m.a ELSE c END, m.d, m.a, m.b FROM t,
    (SELECT x.c AS a, y.c AS b, avg(d) AS d FROM t x, t y, dist WHERE x.c < y.c AND dist.a = x.gene AND dist.b = y.gene GROUP BY 1, 2 ORDER BY avg(d), 1, 2 LIMIT 1) m)
SELECT ma AS a, mb AS b, height, count(*) AS size FROM t WHERE c = ma GROUP BY ALL"""))
def gene_linkage(spark, d):
    """The merges of genes by average linkage."""
    from ..operators.linkage import average_linkage

    return average_linkage(gene_distances(spark, d))


@query()
def gene_order(spark, d):
    """The genes in the order of the linkage tree's leaves."""
    from ..operators.linkage import average_linkage, leaf_order

    pairs = gene_distances(spark, d)
    return leaf_order(average_linkage(pairs), pairs.select("a").union(pairs.select("b")).distinct())
