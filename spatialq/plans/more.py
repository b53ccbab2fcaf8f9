"""Further variants of selection, binning, nulls, scores and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import expr as E
from ..operators import genes as G
from ..operators import gsea as GS
from ..operators import metrics as M
from ..operators import moran as MO
from ..operators import nulls as N
from ..operators import spatial as SP
from . import sqltext as S
from .registry import near, oracle_of, query
from .spatial import BINNED, CLUSTERS, R
from .statistics import CORR, GSEA, RANKS, gsea_inputs


@query(near("x", f"WITH {S.COUNTS}, {BINNED} SELECT bin, count(*) AS n_cells, avg(x) AS x FROM b JOIN cells USING (cell_id) GROUP BY 1"))
def binning_covariates(spark, d):
    """Cells and the mean of a covariate by bin."""
    return SP.bin_covariates(B.count_cells(spark, d), 1000.0, ["x"])


@query(near("mean_cells median_cells", f"WITH {S.COUNTS}, {BINNED}, n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS n_bins, avg(n) AS mean_cells, quantile_cont(n, 0.5) AS median_cells, min(n) AS min_cells, max(n) AS max_cells FROM n"))
def binning_stats(spark, d):
    return SP.count_stats(SP.bin_covariates(B.count_cells(spark, d), 1000.0, []))


def middle_sql(score: str, extra: str = "") -> str:
    return f"""{CLUSTERS}{extra}, m AS (SELECT cluster, row_number() OVER (ORDER BY {score}, cluster) - 1 AS place, count(*) OVER () AS k FROM cl JOIN cells USING (cell_id){', pc' if extra else ''} WHERE cluster >= 0 GROUP BY cluster)
SELECT cell_id FROM cl JOIN m USING (cluster) WHERE place = k // 2"""


PC = """, v AS (SELECT var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM cells), l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS lam FROM v),
pc AS (SELECT abs(b) / sqrt(b * b + (lam - a) ** 2) AS ux, sign(b) * (lam - a) / sqrt(b * b + (lam - a) ** 2) AS uy FROM l)"""


@query(middle_sql("avg(y)"))
def middle_region_y(spark, d):
    c = B.dense_cells(spark, d)
    return SP.middle_cluster(c, SP.dbscan(c, R, 4), "y")


@query(middle_sql("avg(x * ux + y * uy)", PC))
def middle_region_pc1(spark, d):
    c = B.dense_cells(spark, d)
    return SP.middle_cluster(c, SP.dbscan(c, R, 4), "pc1")


@query(near("cx cy", f"""{CLUSTERS.replace('FROM cells a JOIN cells b ON', 'FROM cells a JOIN cells b ON a.cell_type = b.cell_type AND')}, s AS (SELECT cell_type, cluster, count(*) AS n_cells, avg(x) AS cx, avg(y) AS cy FROM cl JOIN cells USING (cell_id) WHERE cluster >= 0 GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT cell_type, n_cells, cx, cy, row_number() OVER (PARTITION BY cell_type ORDER BY n_cells DESC, cluster) - 1 AS region FROM s"""))
def regions_by_type(spark, d):
    """Connected regions inside each cell type, with sizes and centroids."""
    c = B.dense_cells(spark, d)
    return SP.regions(c, SP.dbscan(c, R, 4, ("cell_type",)), 4)


@query(near("density", f"""WITH {S.CELLS}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, count(*) AS n FROM cells),
g AS (SELECT u, v, a + (u + 0.5) * (b - a) / 8 AS gx, c + (v + 0.5) * (d - c) / 8 AS gy, n FROM e, (SELECT unnest(generate_series(0, 7)) AS u), (SELECT unnest(generate_series(0, 7)) AS v)),
p AS (SELECT u, v, n, (x - gx) ** 2 + (y - gy) ** 2 AS d2 FROM g JOIN cells ON sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) <= 4 * 0.03e0)
SELECT CAST(u AS INTEGER) AS bx, CAST(v AS INTEGER) AS by, sum(exp(-d2 / (2 * 0.03e0 * 0.03e0)) / (2 * pi() * 0.03e0 * 0.03e0)) / any_value(n) AS density FROM p GROUP BY 1, 2"""))
def kde_grid(spark, d):
    return SP.kde(B.dense_cells(spark, d), 8, 0.03)


@query(f"""WITH sets AS (SELECT pathway, gene FROM (SELECT p_type AS pathway, p_brand AS gene, count(*) AS n, rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1, 2) WHERE k <= 8), {GSEA},
t AS (SELECT pathway, gene, rank, hit, round(sum(CASE WHEN hit THEN w / nh ELSE -1e0 / nm END) OVER (PARTITION BY pathway ORDER BY rank), 12) AS run FROM (SELECT *, sum(CASE WHEN hit THEN w ELSE 0 END) OVER (PARTITION BY pathway) AS nh, count(*) FILTER (NOT hit) OVER (PARTITION BY pathway) AS nm FROM h)),
x AS (SELECT pathway, max(run) >= -min(run) AS up, arg_min(rank, (-run, rank)) AS top, arg_min(rank, (run, rank)) AS low FROM t GROUP BY 1)
SELECT pathway, gene, rank FROM t JOIN x USING (pathway) WHERE hit AND CASE WHEN up THEN rank <= top ELSE rank >= low END""")
def gsea_leading_edge(spark, d):
    return GS.leading_edge(*gsea_inputs(spark, d))


@query(near("value", f"WITH {S.COUNTS}, t AS (SELECT cell_id, greatest(sum(value), 1) AS t FROM expr GROUP BY 1) SELECT cell_id, gene, ln(1 + value * 1e4 / t) AS value FROM expr JOIN t USING (cell_id)"))
def log_cp10k(spark, d):
    return E.cp10k(B.count_expr(spark, d)).select("cell_id", "gene", "value")


@query(near("spearman", f"WITH {S.dense()}, k AS (SELECT gene, {RANKS.format(c='x')} AS a, {RANKS.format(c='value')} AS b FROM expr JOIN cells USING (cell_id)) SELECT gene, {CORR.format(a='a', b='b')} AS spearman FROM k GROUP BY 1"))
def gene_scores_spearman(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d), "cell_id")
    return M.rank_columns(rows, ["gene"], ["x", "value"]).groupBy("gene").agg(M.pearson("x", "value").alias("spearman"))


@query(near("stat_true p_value p_upper", f"""WITH m AS ({oracle_of("moran_slots")}), t AS (SELECT moran AS stat_true FROM m WHERE slot = 0)
SELECT stat_true, (count(*) FILTER (moran < stat_true) + 1) / (count(*) + 1)::DOUBLE AS p_value, (count(*) FILTER (moran >= stat_true) + 1) / (count(*) + 1)::DOUBLE AS p_upper FROM m, t WHERE slot > 0 GROUP BY 1"""))
def moran_rank_p(spark, d):
    """The share of nulls below the truth: near 1 for strong clustering."""
    slots = N.coordinate_permutation(B.dense_cells(spark, d), 5, 3)
    return MO.lower_rank_p(MO.moran_slots(slots, B.dense_expr(spark, d), 0.03).withColumn("moran", F.round("moran", 6)))


@query(near("x y", f"""WITH {S.CELLS}, s AS (SELECT slot, cell_type, cell_id, x, y, (x + ({S.uniform(9, 'slot', 'cell_type', "'jx'")} * 2 - 1) * 0.05e0) AS sx, (y + ({S.uniform(9, 'slot', 'cell_type', "'jy'")} * 2 - 1) * 0.05e0) AS sy FROM cells, (SELECT unnest(generate_series(1, 3)) AS slot)),
t AS (SELECT slot, cell_type, cell_id, x, y, (CAST(floor(sx / 0.1e0) AS BIGINT) + 1000000) * 2000001 + CAST(floor(sy / 0.1e0) AS BIGINT) + 1000000 AS bin FROM s),
b AS (SELECT slot, cell_type, bin, avg(x) AS cx, avg(y) AS cy FROM t GROUP BY 1, 2, 3),
a AS (SELECT *, row_number() OVER (PARTITION BY slot, cell_type ORDER BY bin) AS r FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY slot, cell_type ORDER BY {S.key(9, 'slot', 'cell_type', 'bin')}, bin) AS r FROM b)
SELECT 0 AS slot, cell_id, x, y FROM cells UNION ALL
SELECT t.slot, cell_id, x + p.cx - a.cx AS x, y + p.cy - a.cy AS y FROM t JOIN a ON a.slot = t.slot AND a.cell_type = t.cell_type AND a.bin = t.bin JOIN p ON p.slot = a.slot AND p.cell_type = a.cell_type AND p.r = a.r"""))
def block_permute_by_type(spark, d):
    """Each cell type has a mesh of its own, and its blocks trade places among themselves."""
    return N.block_permutation(B.dense_cells(spark, d), 3, 9, 0.05, keys=("cell_type",))


@query(near("mean dispersion score", f"""WITH {S.COUNTS}, y AS (SELECT cell_type, cell_id, gene, value FROM expr JOIN cells USING (cell_id)), t AS (SELECT cell_id, sum(value) AS t FROM expr GROUP BY 1 HAVING sum(value) > 0),
c AS (SELECT cell_type, count(*)::DOUBLE AS n FROM cells GROUP BY 1), s AS (SELECT cell_type, gene, sum(value * 1e4 / t) AS s, sum((value * 1e4 / t) * (value * 1e4 / t)) AS q FROM y JOIN t USING (cell_id) GROUP BY 1, 2),
m AS (SELECT cell_type, gene, s / n AS mean, (q - s * s / n) / (n - 1) AS var FROM s JOIN c USING (cell_type)),
l AS (SELECT cell_type, gene, ln(1 + mean) AS mean, ln(var / mean) AS dispersion FROM m WHERE mean > 0 AND var > 0),
b AS (SELECT *, least(floor((mean - min(mean) OVER k) / ((max(mean) OVER k - min(mean) OVER k) / 20)), 19) AS bin FROM l WINDOW k AS (PARTITION BY cell_type)),
z AS (SELECT cell_type, gene, mean, dispersion, CASE WHEN coalesce(stddev_samp(dispersion) OVER w, 0) = 0 THEN 1e0 ELSE (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END AS score FROM b WINDOW w AS (PARTITION BY cell_type, bin)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(score, 9) DESC, gene) AS rank FROM z)
SELECT * FROM r WHERE rank <= 8"""))
def hvg_by_type(spark, d):
    """The most variable genes inside each cell type."""
    cells = B.count_cells(spark, d)
    n = cells.groupBy("cell_type").agg(F.count("*").alias("n"))
    return G.highly_variable(B.count_expr(spark, d).join(cells.select("cell_id", "cell_type"), "cell_id"), n, 8, keys=("cell_type",))
