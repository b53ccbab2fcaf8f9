"""Closed-form and iterated decoders, spatially variable genes, covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import decoders as D
from ..operators import expr as E
from ..operators import metrics as M
from ..operators import nulls as N
from ..operators import vectors as V
from ..operators.ranks import bh_qvalues
from . import sqltext as S
from .nulls import PERM
from .registry import near, query

DEPTH = """mid AS (SELECT slot, list_sort(list(x))[(count(*) - 1) // 2 + 1] AS m FROM slots GROUP BY 1), depth AS (SELECT slot, cell_id, abs(x - m) AS z FROM slots JOIN mid USING (slot)),
fit AS (SELECT slot, gene, count(*) AS n, regr_syy(value, z) - regr_sxy(value, z) ** 2 / regr_sxx(value, z) AS sse FROM depth JOIN expr USING (cell_id) GROUP BY 1, 2),
loss AS (SELECT slot, sum(sse) / sum(n) AS mse, sum(n) AS n FROM fit GROUP BY 1), nll AS (SELECT slot, n / 2e0 * ln(2 * pi() * mse + 1e-12) + n / 2e0 AS stat FROM loss)"""


def depth_losses(slots, expr):
    """(slot, mse, stat): loss of linear decoders of all genes on each slot's depth axis.

    A cell's measurements are one array, joined once to its depths; vector sums by slot
    are all that is shuffled.
    """
    rows = D.depth_axis(slots).join(V.packed(expr), "cell_id")
    s = rows.groupBy("slot").agg(
        F.count("*").cast("double").alias("n"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"), V.total(F.col("a")).alias("sy"),
        V.total(F.transform("a", lambda y: y * y)).alias("syy"), V.total(F.transform("a", lambda y: y * F.col("z"))).alias("szy"),
    )
    vz = F.col("szz") - F.col("sz") * F.col("sz") / F.col("n")

    def sse(g):
        c = g["szy"] - F.col("sz") * g["sy"] / F.col("n")
        sst = g["syy"] - g["sy"] * g["sy"] / F.col("n")
        return F.greatest(sst - F.when(vz > 1e-12, c * c / vz).otherwise(0.0), F.lit(0.0))

    each = F.transform(F.arrays_zip("sy", "syy", "szy"), sse)
    loss = s.select("slot", F.aggregate(each, F.lit(0.0), lambda t, x: t + x).alias("sse"), (F.col("n") * F.size("sy")).alias("n"))
    return loss.select("slot", (F.col("sse") / F.col("n")).alias("mse"), M.nll_of_mse(F.col("sse") / F.col("n"), F.col("n")).alias("stat"))


@query(near("stat_true p_value", f"WITH {S.dense()}, {PERM.replace('generate_series(1, 5)', 'generate_series(1, 19)')}, {DEPTH}, t AS (SELECT stat AS stat_true FROM nll WHERE slot = 0) SELECT stat_true, (count(*) FILTER (stat <= stat_true) + 1) / (count(*) + 1)::DOUBLE AS p_value, count(*) AS n_perms FROM nll, t WHERE slot > 0 GROUP BY 1"))
def midline_existence(spark, d):
    """Permutation test of a fixed depth axis: distance from the median vertical line, linear decoders.

    A restriction of the trained test: the line's angle and offset are not learned.
    """
    slots = N.coordinate_permutation(B.dense_cells(spark, d), 19, 3)
    return M.permutation_p(depth_losses(slots, B.dense_expr(spark, d)), [])


@query(near("mse stat", f"WITH {S.dense()}, {PERM}, {DEPTH} SELECT slot, mse, stat FROM loss JOIN nll USING (slot)"))
def slot_losses(spark, d):
    return depth_losses(N.coordinate_permutation(B.dense_cells(spark, d), 5, 3), B.dense_expr(spark, d))


@query(near("slope intercept", f"WITH {S.dense()} SELECT gene, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM expr JOIN cells USING (cell_id) GROUP BY 1"))
def ols_linear(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    return D.linear_fit(D.linear_sums(rows, ["gene"])).select("gene", "slope", "intercept")


QUAD = """m AS (SELECT gene, count(*) AS n, avg(x) AS mz, avg(x * x) AS m2, avg(value) AS my, avg(x ** 3) AS m3, avg(x ** 4) AS m4, avg(x * value) AS mzy, avg(x * x * value) AS m2y, avg(value * value) AS myy FROM expr JOIN cells USING (cell_id) GROUP BY 1),
s AS (SELECT *, m2 - mz * mz AS s11, m3 - mz * m2 AS s12, m4 - m2 * m2 AS s22, mzy - mz * my AS t1, m2y - m2 * my AS t2 FROM m),
q AS (SELECT *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
fit AS (SELECT gene, n, b2, b1, my - b1 * mz - b2 * m2 AS b0, n * (myy - my * my) AS sst, n * (myy - my * my) - n * (b1 * t1 + b2 * t2) AS sse FROM q)"""


@query(near("b2 b1 b0 sst sse", f"WITH {S.dense()}, {QUAD} SELECT * FROM fit"))
def ols_quadratic(spark, d):
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    return D.quadratic_fit(rows, ["gene"])


@query(near("f_stat p_value", f"WITH {S.dense()}, {QUAD}, f AS (SELECT gene, n, ((sst - sse) / 2) / (sse / (n - 3)) AS f_stat FROM fit) SELECT gene, f_stat, (1 + 2 * f_stat / (n - 3)) ** (-(n - 3) / 2e0) AS p_value FROM f"))
def ftest_stats(spark, d):
    """F statistics of quadratic decoders; the check has the closed form of the tail with two terms."""
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    return D.with_f_p(D.quadratic_fit(rows, ["gene"]), 2).select("gene", "f_stat", "p_value")


@query(near("p_value q_value", f"""WITH {S.dense()}, {QUAD}, f AS (SELECT gene, n, ((sst - sse) / 2) / (sse / (n - 3)) AS f FROM fit), p AS (SELECT gene, (1 + 2 * f / (n - 3)) ** (-(n - 3) / 2e0) AS p_value FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, gene) AS r, count(*) OVER () AS k FROM p), qv AS (SELECT gene, p_value, least(1, min(p_value * k / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM r)
SELECT * FROM qv WHERE q_value < 0.9"""))
def svg_genes(spark, d):
    """Spatially variable genes: quadratic fit, F test, q-values below a limit."""
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    return bh_qvalues(D.with_f_p(D.quadratic_fit(rows, ["gene"]), 2).select("gene", "p_value")).filter("q_value < 0.9").select("gene", "p_value", "q_value")


@query()
def svg_ftest(spark, d):
    """F tests of linear decoders, whose tail needs the incomplete beta function."""
    rows = B.dense_expr(spark, d).join(B.dense_cells(spark, d).select("cell_id", F.col("x").alias("z")), "cell_id")
    return D.with_f_p(D.linear_fit(D.linear_sums(rows, ["gene"])), 1).select("gene", "f_stat", "p_value")


@query()
def poisson_irls(spark, d):
    """Poisson decoders of the sparse counts with cell totals as exposure."""
    cells = B.count_cells(spark, d)
    e = E.densify(cells, B.count_expr(spark, d))
    total = e.groupBy("cell_id").agg(F.sum("value").alias("exposure")).filter("exposure > 0")
    rows = e.join(total, "cell_id").join(cells.select("cell_id", F.col("x").alias("z")), "cell_id")
    return D.poisson_irls(rows).withColumn("beta", F.transform("beta", lambda b: F.round(b, 6)))


@query(near("value", f"""WITH {S.dense()}, z AS (SELECT cell_id, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS z FROM cells),
r AS (SELECT cell_id, gene, value - (regr_slope(value, z) OVER (PARTITION BY gene) * z + regr_intercept(value, z) OVER (PARTITION BY gene)) AS value FROM expr JOIN z USING (cell_id))
SELECT cell_id, gene, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS value FROM r"""))
def freedman_lane(spark, d):
    """Measurements with a covariate's linear part taken out, standardised by gene."""
    from ..operators.rows import zscore_columns

    cov = zscore_columns(B.dense_cells(spark, d).select("cell_id", F.col("y").alias("z")), ["z"])
    rows = B.dense_expr(spark, d).join(cov, "cell_id")
    fit = D.linear_fit(D.linear_sums(rows, ["gene"])).select("gene", "slope", "intercept")
    res = rows.join(F.broadcast(fit), "gene").select("cell_id", "gene", (F.col("value") - F.col("slope") * F.col("z") - F.col("intercept")).alias("value"))
    return E.zscore(res).select("cell_id", "gene", "value")


@query(near("stat_true stat_covariate p_value", f"""WITH {S.dense()}, {PERM}, {DEPTH}, c AS (SELECT gene, count(*) AS n, regr_syy(value, y) - regr_sxy(value, y) ** 2 / regr_sxx(value, y) AS sse FROM expr JOIN cells USING (cell_id) GROUP BY 1),
cl AS (SELECT sum(n) / 2e0 * ln(2 * pi() * (sum(sse) / sum(n)) + 1e-12) + sum(n) / 2e0 AS stat_covariate FROM c)
SELECT (SELECT stat FROM nll WHERE slot = 0) AS stat_true, stat_covariate, (count(*) FILTER (stat <= stat_covariate) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM nll, cl WHERE slot > 0 GROUP BY stat_covariate"""))
def covariate_comparison(spark, d):
    """The loss of a fixed covariate's decoders against the same nulls as the depth axis."""
    e, c = B.dense_expr(spark, d), B.dense_cells(spark, d)
    losses = depth_losses(N.coordinate_permutation(c, 5, 3), e)
    fit = D.linear_fit(D.linear_sums(e.join(c.select("cell_id", F.col("y").alias("z")), "cell_id"), ["gene"]))
    own = fit.agg((F.sum("sse") / F.sum("n")).alias("m"), F.sum("n").alias("n")).select(M.nll_of_mse(F.col("m"), F.col("n")).alias("stat_covariate"))
    both = losses.crossJoin(F.broadcast(own))
    return both.groupBy("stat_covariate").agg(
        F.max(F.when(F.col("slot") == 0, F.col("stat"))).alias("stat_true"),
        ((F.count_if((F.col("slot") > 0) & (F.col("stat") <= F.col("stat_covariate"))) + 1) / (F.count_if(F.col("slot") > 0) + 1)).alias("p_value"),
    )
