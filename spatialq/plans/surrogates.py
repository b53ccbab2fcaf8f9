"""Spatial modes, and nulls that keep autocorrelation or variograms; what they keep is checked against SQL on the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import matched as MT
from ..operators import modes as MD
from ..operators import moran as MO
from ..operators import spatial as SP
from ..sources.scratch import written
from . import sqltext as S
from .nulls import PERM
from .registry import near, query
from .spatial import PAIRS, WEIGHTS

NEAR = 12
#: Pairs within the radius that holds NEAR cells on average; it shrinks as cells become more.
NEAR_PAIRS = f"rr AS (SELECT sqrt((max(x) - min(x)) * (max(y) - min(y)) * {NEAR}e0 / (pi() * count(*))) AS r FROM cells), " + PAIRS.format(r="(SELECT r FROM rr)")


def radius(cells) -> float:
    return SP.density_radius(cells, float(NEAR))


def nulls_in_long_form(nulls, slot: str = "slot"):
    """(slot, cell_id, gene, value) of the nulls' arrays."""
    return nulls.filter("slot > 0").select(slot, "cell_id", F.posexplode("a").alias("g", "value")).select(
        slot, "cell_id", F.concat(F.lit("g"), F.lpad((F.col("g") + 2).cast("string"), 2, "0")).alias("gene"), "value"
    )


def modes_of(spark, d, **how):
    cells = B.dense_cells(spark, d)
    return MD.mode_surrogates(cells, B.dense_expr(spark, d), 2, 3, radius(cells), **how)


@query(near("moran", f"""WITH {S.dense()}, {NEAR_PAIRS}, {WEIGHTS}, z AS (SELECT cell_id, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM expr),
c AS (SELECT a.gene, sum(w * a.z * b.z) AS c FROM w JOIN z a ON a.cell_id = w.i JOIN z b ON b.cell_id = w.j AND a.gene = b.gene GROUP BY 1),
o AS (SELECT gene, count(*) / (SELECT sum(w) FROM w) * any_value(c) / sum(z * z) AS moran FROM z JOIN c USING (gene) GROUP BY 1)
SELECT slot, gene, moran FROM o, (SELECT unnest([1, 2]) AS slot)"""))
def mode_null_moran(spark, d):
    """Moran's I of every gene in nulls of spatial modes: that of the truth, which is the SQL."""
    cells, e = B.dense_cells(spark, d), nulls_in_long_form(written(modes_of(spark, d), "nulls"))
    out = None
    for slot in (1, 2):
        one = MO.morans_i(cells, e.filter(F.col("slot") == slot).drop("slot"), radius(cells)).select(F.lit(slot).alias("slot"), "gene", "moran")
        out = one if out is None else out.unionByName(one)
    return out


@query(near("covariance", f"WITH {S.dense()} SELECT 1 AS slot, a.gene AS a, b.gene AS b, covar_pop(a.value, b.value) AS covariance FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY 2, 3 UNION ALL "
            f"SELECT 2, * FROM (WITH {S.dense()} SELECT a.gene AS a, b.gene AS b, covar_pop(a.value, b.value) AS covariance FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY 1, 2)"))
def mode_null_covariance(spark, d):
    """Covariances of genes in nulls whose long modes alone take signs: those of the truth."""
    e = nulls_in_long_form(modes_of(spark, d, truncate=0.1, calibration=1.0))
    a = e.select("slot", "cell_id", F.col("gene").alias("a"), F.col("value").alias("va"))
    b = a.select("slot", "cell_id", F.col("a").alias("b"), F.col("va").alias("vb"))
    return a.join(b, ["slot", "cell_id"]).filter("a <= b").groupBy("slot", "a", "b").agg(F.covar_pop("va", "vb").alias("covariance"))


@query(near("value", f"WITH {S.dense()} SELECT slot, gene, value, count(*) AS n FROM expr, (SELECT unnest([1, 2]) AS slot) GROUP BY ALL"))
def mode_null_values(spark, d):
    """The values of every gene in rank-matched nulls: the same values as often as in the truth."""
    return nulls_in_long_form(modes_of(spark, d, ranks=True)).groupBy("slot", "gene", "value").agg(F.count("*").alias("n"))


@query("SELECT unnest([0, 1, 2]) AS mode, 0e0 AS residual, 1e0 AS length")
def mode_residuals(spark, d):
    """The leading spatial modes: how far the operator takes each from its own direction, over its eigenvalue."""
    cells = B.dense_cells(spark, d)
    links = MD.layout(cells, radius(cells))
    values, modes = MD.leading_modes(links, 3)
    return MD.mode_residuals(links, modes, values).select("mode", (F.col("residual") / F.abs("eigenvalue")).alias("residual"), "length")


WIDTHS = (0.15, 0.3, 0.6)  # of the radius
NORMAL = "sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * (1 - {b}))"


def normal_sql(seed: int, *parts: str) -> str:
    return NORMAL.format(a=S.uniform(seed, *parts, "'a'"), b=S.uniform(seed, *parts, "'b'"))


MATCHED = f"""{S.dense()}, {NEAR_PAIRS}, {PERM.replace("generate_series(1, 5)", "generate_series(1, 2)")},
z AS (SELECT cell_id, CAST(substr(gene, 2) AS INT) - 2 AS g, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS z FROM expr),
src AS (SELECT slot, cell_id AS src, row_number() OVER (PARTITION BY slot ORDER BY {S.key(3, "slot", "cell_id")}, cell_id) AS r FROM s),
dealt AS (SELECT own.slot, own.cell_id, g, z FROM own JOIN src USING (slot, r) JOIN z ON z.cell_id = src),
h AS (SELECT k, r * h AS h FROM (SELECT unnest([0, 1, 2]) AS k, unnest([0.15e0, 0.3e0, 0.6e0]) AS h), rr),
ends AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs),
sums AS (SELECT slot, i AS cell_id, g, k, sum(exp(-d / h) * z) AS s, sum(exp(-d / h)) AS w FROM ends JOIN dealt ON cell_id = j, h GROUP BY ALL),
y AS (SELECT a.slot, a.cell_id, a.g, h.k, (a.z + coalesce(s, 0)) / (1 + coalesce(w, 0)) AS y FROM dealt a CROSS JOIN h LEFT JOIN sums b ON a.slot = b.slot AND a.cell_id = b.cell_id AND a.g = b.g AND h.k = b.k),
e AS (SELECT i, j, least(floor(d / (r / 6)), 5) AS bin FROM pairs, rr),
t AS (SELECT a.g, bin, sum((a.z - b.z) ** 2) / (2 * count(*)) AS t FROM e JOIN z a ON a.cell_id = i JOIN z b ON b.cell_id = j AND a.g = b.g GROUP BY 1, 2),
v AS (SELECT a.slot, a.g, a.k, bin, sum((a.y - b.y) ** 2) / (2 * count(*)) AS s FROM e JOIN y a ON a.cell_id = i JOIN y b ON b.cell_id = j AND a.g = b.g AND a.k = b.k AND a.slot = b.slot GROUP BY ALL),
f AS (SELECT slot, g, k, covar_pop(s, t) / var_pop(s) AS beta, avg(t) - covar_pop(s, t) / var_pop(s) * avg(s) AS alpha, count(*) * (var_pop(t) - covar_pop(s, t) ** 2 / var_pop(s)) AS err FROM v JOIN t USING (g, bin) GROUP BY ALL),
c AS (SELECT slot, g, k, alpha, beta FROM f QUALIFY row_number() OVER (PARTITION BY slot, g ORDER BY err, k) = 1)"""


def matched(spark, d):
    cells = B.dense_cells(spark, d)
    r = radius(cells)
    return MT.variogram_matched(cells, B.dense_expr(spark, d), 2, 3, r, [r * w for w in WIDTHS], 6)


@query(near("width alpha beta", f"WITH {MATCHED} SELECT slot, g, h AS width, alpha, beta FROM c JOIN h USING (k)"))
def variogram_matched_choice(spark, d):
    """The kernel width of every gene and null whose variogram fits the true one best."""
    return matched(spark, d)[0]


@query(near("value", f"WITH {MATCHED} SELECT slot, y.cell_id, g, sqrt(abs(beta)) * y + sqrt(abs(alpha)) * {normal_sql(3, 'slot', 'y.cell_id', 'g')} AS value FROM y JOIN c USING (slot, g, k)"))
def variogram_matched_null(spark, d):
    """All values of the nulls."""
    return matched(spark, d)[1].filter("slot > 0").select("slot", "cell_id", F.posexplode("a").alias("g", "value"))


CENTERS = [(0, 0.1, 0.1), (1, -0.1, 0.1), (2, 0.1, -0.1), (3, -0.1, -0.1)]
WAVES = ", ".join(f"{normal_sql(5, 'lobule', 'draw', 'm', repr(c))} / 0.7e0 AS w{c}" for c in "xy")
LOBULES = f"""{S.dense()}, ctr AS (SELECT cell_id, x, y, unnest([0, 1, 2, 3]) AS lobule, unnest([0.1e0, -0.1e0, 0.1e0, -0.1e0]) AS cx, unnest([0.1e0, 0.1e0, -0.1e0, -0.1e0]) AS cy FROM cells),
near AS (SELECT cell_id, x, y, lobule, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS target FROM ctr QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2), lobule) = 1),
lob AS (SELECT near.*, value AS axis, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8) AS zx, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8) AS zy
  FROM near JOIN expr USING (cell_id) WHERE gene = 'g02' AND target < 0.2 WINDOW w AS (PARTITION BY lobule)),
rt AS (SELECT lobule, cell_id, row_number() OVER (PARTITION BY lobule ORDER BY target, cell_id) AS rt, row_number() OVER (PARTITION BY lobule ORDER BY axis, cell_id) AS ra FROM lob),
obs AS (SELECT lobule, count(*) AS n_cells, abs(corr(ra, rt)) AS observed FROM rt GROUP BY 1),
wave AS (SELECT lobule, draw, m, {WAVES}, 2 * pi() * {S.uniform(5, 'lobule', 'draw', 'm', "'p'")} AS p
  FROM (SELECT lobule, unnest(generate_series(0, 19)) AS draw FROM obs), (SELECT unnest(generate_series(0, 31)) AS m)),
field AS (SELECT lobule, draw, cell_id, sum(cos(wx * zx + wy * zy + p)) * sqrt(2 / 32e0) AS value FROM lob JOIN wave USING (lobule) GROUP BY ALL),
rf AS (SELECT lobule, draw, cell_id, row_number() OVER (PARTITION BY lobule, draw ORDER BY value, cell_id) AS rf FROM field),
nulls AS (SELECT lobule, draw, abs(corr(rf, rt)) AS rho FROM rf JOIN rt USING (lobule, cell_id) GROUP BY 1, 2)"""


def lobule_recovery(spark, d):
    """Cells within 0.2 of their nearest centre; the axis is gene g02, the target the distance to the centre."""
    cells = B.dense_cells(spark, d)
    own = SP.nearest_center(cells, CENTERS).filter("d < 0.2").join(cells, "cell_id")
    axis = B.dense_expr(spark, d).filter("gene = 'g02'").select("cell_id", F.col("value").alias("axis"))
    rows = own.join(axis, "cell_id").select("cell_id", F.col("center").alias("lobule"), "x", "y", "axis", F.col("d").alias("target"))
    return MT.axis_recovery(rows, draws=20, length=0.7, features=32, seed=5)


@query(near("rho", f"WITH {LOBULES} SELECT * FROM nulls"))
def lobule_axes(spark, d):
    """How well random smooth axes follow the target, by lobule."""
    return lobule_recovery(spark, d)[1]


@query(near("observed null_mean p_value", f"WITH {LOBULES} SELECT lobule, any_value(n_cells) AS n_cells, any_value(observed) AS observed, avg(rho) AS null_mean, avg(CASE WHEN rho >= observed THEN 1e0 ELSE 0 END) AS p_value FROM nulls JOIN obs USING (lobule) GROUP BY 1"))
def lobule_pvalues(spark, d):
    return MT.recovery_by_key(*lobule_recovery(spark, d))


@query(near("observed null_mean p_value", f"""WITH {LOBULES}, o AS (SELECT count(*) AS n_lobules, avg(observed) AS observed FROM obs), m AS (SELECT draw, avg(rho) AS rho FROM nulls GROUP BY 1)
SELECT n_lobules, observed, avg(rho) AS null_mean, avg(CASE WHEN rho >= observed THEN 1e0 ELSE 0 END) AS p_value FROM m, o GROUP BY 1, 2"""))
def lobule_aggregate(spark, d):
    """One statement over all lobules."""
    return MT.recovery(*lobule_recovery(spark, d))
