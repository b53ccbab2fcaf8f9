"""Normalisation, scores and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import scalar
from ..operators import decoders as D
from ..operators import expr as E
from ..operators import metrics as M
from ..operators import rows as R
from . import sqltext as S
from .registry import near, query


@query(near("log_total", f"WITH {S.COUNTS} SELECT cell_id, ln(1 + greatest(sum(value), 0)) AS log_total FROM expr GROUP BY 1"))
def library_size(spark, d):
    return E.library_size(B.count_expr(spark, d))


CPM = f"WITH {S.COUNTS}, cpm AS (SELECT cell_id, gene, coalesce(value * 1e6 / nullif(sum(value) OVER (PARTITION BY cell_id), 0), 0) AS value FROM expr)"


@query(near("value", f"{CPM} SELECT * FROM cpm"))
def cpm(spark, d):
    return E.cpm(B.count_expr(spark, d))


@query(near("value", f"{CPM} SELECT cell_id, gene, ln(1 + value) AS value FROM cpm"))
def log_cpm(spark, d):
    return E.log1p(E.cpm(B.count_expr(spark, d)))


@query(near("value", f"{CPM}, {S.GRID.replace('expr', 'cpm')}, l AS (SELECT cell_id, gene, ln(1 + value) AS value FROM dense) SELECT cell_id, gene, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS value FROM l"))
def log_cpm_z(spark, d):
    return E.zscore(E.log1p(E.densify(B.count_cells(spark, d), E.cpm(B.count_expr(spark, d))))).select("cell_id", "gene", "value")


@query(near("value", f"WITH {S.dense()} SELECT cell_id, gene, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS value FROM expr"))
def zscore(spark, d):
    return E.zscore(B.dense_expr(spark, d)).select("cell_id", "gene", "value")


@query(near("z", "SELECT c_custkey AS cell_id, CASE WHEN stddev_pop(c_acctbal) OVER () < 1e-8 THEN 0 ELSE (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () END AS z FROM customer"))
def zscore_covariate(spark, d):
    c = B.count_cells(spark, d)
    s = c.agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    z = F.when(F.col("_s") < 1e-8, 0.0).otherwise((F.col("x") - F.col("_m")) / F.col("_s"))
    return c.crossJoin(F.broadcast(s)).select("cell_id", z.alias("z"))


@query(near("x y", f"WITH {S.CELLS} SELECT cell_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM cells"))
def coord_zscore(spark, d):
    return R.zscore_columns(B.dense_cells(spark, d), ["x", "y"]).select("cell_id", "x", "y")


@query(near("value", f"WITH {S.dense()} SELECT cell_id, gene, cell_type, value - avg(value) OVER (PARTITION BY cell_type, gene) AS value FROM expr JOIN cells USING (cell_id)"))
def celltype_residuals(spark, d):
    return E.residuals(B.dense_expr(spark, d), B.dense_cells(spark, d)).select("cell_id", "gene", "cell_type", "value")


@query(near("value", f"""{CPM}, l AS (SELECT cell_id, gene, cell_type, ln(1 + value) AS value FROM cpm JOIN cells USING (cell_id))
SELECT cell_id, gene, cell_type, (value - avg(value) OVER (PARTITION BY cell_type, gene)) / (stddev_pop(value) OVER (PARTITION BY cell_type, gene) + 1e-8) AS value FROM l"""))
def preprocess_by_type(spark, d):
    return E.preprocess_by_type(B.count_expr(spark, d), B.count_cells(spark, d)).select("cell_id", "gene", "cell_type", "value")


@query(near("factor", f"WITH {S.COUNTS}, {S.GRID} SELECT cell_type, gene, greatest(avg(value), 1e-3) AS factor FROM dense JOIN cells USING (cell_id) GROUP BY 1, 2"))
def poisson_type_sf(spark, d):
    cells = B.count_cells(spark, d)
    return E.type_size_factors(E.densify(cells, B.count_expr(spark, d)), cells)


@query(near("signal", f"WITH {S.dense()} SELECT cell_id, avg(abs(value)) AS signal FROM expr GROUP BY 1"))
def cell_signal(spark, d):
    return E.signal(B.dense_expr(spark, d))


@query(near("total log_total pct", f"""WITH {S.COUNTS} SELECT cell_id, sum(value) AS total, ln(1 + sum(value)) AS log_total, count(*) FILTER (value > 0) AS n_genes,
coalesce(100 * sum(CASE WHEN starts_with(upper(gene), 'BRAND#1') THEN value ELSE 0 END) / nullif(sum(value), 0), 0) AS pct FROM expr GROUP BY 1"""))
def qc_columns(spark, d):
    return E.qc(B.count_expr(spark, d), "Brand#1")


@query(near("z", f"WITH {S.CELLS}, m AS (SELECT list_sort(list(x))[(count(*) - 1) // 2 + 1] AS m FROM cells), a AS (SELECT cell_id, abs(x - m) AS a FROM cells, m) SELECT cell_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS z FROM a"))
def midline(spark, d):
    """Distance from the lower-median line, standardised."""
    z = D.depth_axis(B.dense_cells(spark, d).withColumn("slot", F.lit(0))).select("cell_id", "z")
    return R.zscore_columns(z, ["z"])


@query(near("z", f"""WITH {S.CELLS}, a AS (SELECT cell_id, abs((x - avg(x) OVER ()) * sin(0.7e0) + (y - avg(y) OVER ()) * cos(0.7e0) - 0.2) AS a FROM cells)
SELECT cell_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS z FROM a"""))
def midline_theta(spark, d):
    import math

    c = B.dense_cells(spark, d)
    m = c.agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    a = F.abs((F.col("x") - F.col("_x")) * math.sin(0.7) + (F.col("y") - F.col("_y")) * math.cos(0.7) - 0.2)
    return R.zscore_columns(c.crossJoin(F.broadcast(m)).select("cell_id", a.alias("z")), ["z"])


@query(near("v", "SELECT c_custkey AS cell_id, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER () + 1e-8) AS v FROM customer"))
def minmax(spark, d):
    c = B.count_cells(spark, d)
    e = c.agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    return c.crossJoin(F.broadcast(e)).select("cell_id", M.minmax(F.col("x"), F.col("_a"), F.col("_b")).alias("v"))


HEX = """h AS (SELECT cell_id, (0.5773502691896257e0 * x - (1e0 / 3) * y) / 25 AS q, (2e0 / 3) * y / 25 AS r FROM cells),
k AS (SELECT cell_id, q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h),
f AS (SELECT cell_id, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS q,
  CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s)) AND abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS r FROM k)"""


@query(f"WITH {S.POINTS}, {HEX} SELECT cell_id, (CAST(q AS BIGINT) + 1000000) * 2000001 + CAST(r AS BIGINT) + 1000000 AS bin FROM f")
def hex_bin(spark, d):
    return B.points(spark, d).select("cell_id", scalar.hex_bin(F.col("x"), F.col("y"), 25.0).alias("bin"))


@query(f"WITH {S.POINTS} SELECT cell_id, (CAST(floor(x / 50) AS BIGINT) + 1000000) * 2000001 + CAST(floor(y / 50) AS BIGINT) + 1000000 AS bin FROM cells")
def square_bin(spark, d):
    return B.points(spark, d).select("cell_id", scalar.square_bin(F.col("x"), F.col("y"), 25.0).alias("bin"))


@query(near("sx sy hx hy", f"""WITH {S.POINTS}, {HEX}, b AS (SELECT DISTINCT CAST(floor(x / 50) AS BIGINT) AS i, CAST(floor(y / 50) AS BIGINT) AS j, CAST(q AS BIGINT) AS q, CAST(r AS BIGINT) AS r FROM cells JOIN f USING (cell_id))
SELECT i, j, (i + 0.5e0) * 50 AS sx, (j + 0.5e0) * 50 AS sy, q, r, (1.7320508075688772e0 * q + 0.8660254037844386e0 * r) * 25 AS hx, 1.5e0 * r * 25 AS hy FROM b"""))
def bin_centers(spark, d):
    """Ids decoded to indices and centres, of square and hexagonal bins."""
    p = B.points(spark, d)
    ids = p.select(scalar.square_bin(F.col("x"), F.col("y"), 25.0).alias("s"), scalar.hex_bin(F.col("x"), F.col("y"), 25.0).alias("h")).distinct()
    (i, j), (q, r) = scalar.unpack(F.col("s")), scalar.unpack(F.col("h"))
    (sx, sy), (hx, hy) = scalar.square_center(F.col("s"), 25.0), scalar.hex_center(F.col("h"), 25.0)
    return ids.select(i.alias("i"), j.alias("j"), sx.alias("sx"), sy.alias("sy"), q.alias("q"), r.alias("r"), hx.alias("hx"), hy.alias("hy"))


@query(near("area x0 y2", f"WITH {S.POINTS}, b AS (SELECT DISTINCT floor(x / 50) AS i, floor(y / 50) AS j FROM cells) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, 4 AS corners, 2500e0 AS area, i * 50 AS x0, (j + 1) * 50 AS y2 FROM b"))
def bin_polygons(spark, d):
    ids = B.points(spark, d).select(scalar.square_bin(F.col("x"), F.col("y"), 25.0).alias("s")).distinct()
    i, j = scalar.unpack(F.col("s"))
    poly = ids.select(i.alias("i"), j.alias("j"), scalar.square_polygon(*scalar.square_center(F.col("s"), 25.0), 25.0).alias("p"))
    area = (F.col("p")[1]["x"] - F.col("p")[0]["x"]) * (F.col("p")[2]["y"] - F.col("p")[1]["y"])
    return poly.select("i", "j", F.size("p").alias("corners"), area.alias("area"), F.col("p")[0]["x"].alias("x0"), F.col("p")[2]["y"].alias("y2"))


@query("""WITH p AS (SELECT c_custkey AS cell_id, (c_custkey * 37 % 1009) / 1009e0 AS x, (c_custkey * 101 % 997) / 997e0 AS y FROM customer)
SELECT cell_id, x >= 0 AND x <= 1 AS square, (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.25 + 1e-9 AS circle,
(x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.25 + 1e-9 AND y >= 0.5 - 1e-9 AS semicircle, y <= 1 - 2 * abs(x - 0.5) + 1e-9 AS triangle,
NOT (abs(x - 0.5) < 0.25 - 1e-9 AND abs(y - 0.5) < 0.25 - 1e-9) AS cutout FROM p""")
def shape_mask(spark, d):
    k = F.col("cell_id")
    p = B.count_cells(spark, d).select("cell_id", ((k * 37 % 1009) / F.lit(1009.0)).alias("x"), ((k * 101 % 997) / F.lit(997.0)).alias("y"))
    return p.select("cell_id", *(scalar.shape_mask(F.col("x"), F.col("y"), s).alias(s) for s in ("square", "circle", "semicircle", "triangle", "cutout")))


@query("""SELECT DISTINCT o_orderpriority AS run_name, regexp_extract(o_orderpriority, '^(\\d+)-', 1) AS stage, regexp_extract(o_orderpriority, '-(.*)$', 1) AS region,
translate(o_orderpriority, ' /', '__') AS safe FROM orders""")
def parse_run_name(spark, d):
    r = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("run_name")).distinct()
    return r.select("run_name", F.regexp_extract("run_name", r"^(\d+)-", 1).alias("stage"), F.regexp_extract("run_name", "-(.*)$", 1).alias("region"), scalar.safe_name(F.col("run_name")).alias("safe"))


@query(f"""WITH {S.CELLS}, n AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1)
SELECT cell_type, b AS batch_size, CAST(ceil(n / b::DOUBLE) AS BIGINT) AS steps, CAST(ceil(5000 / ceil(n / b::DOUBLE)) AS BIGINT) AS epochs FROM n, (SELECT unnest([8, 16, 32, 64, 128, 256, 512]) AS b)""")
def update_schedule(spark, d):
    """Epochs that give each batch size about 5000 updates on the cells of each type."""
    n = B.dense_cells(spark, d).groupBy("cell_type").agg(F.count("*").alias("n"))
    b = n.withColumn("batch_size", F.explode(F.array(*(F.lit(2**k) for k in range(3, 10)))))
    steps = F.ceil(F.col("n") / F.col("batch_size"))
    return b.select("cell_type", "batch_size", steps.alias("steps"), F.ceil(F.lit(5000.0) / steps).alias("epochs"))


SCALE = "s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM cells)"


@query(near("x y back_x back_y", f"WITH {S.CELLS}, {SCALE} SELECT cell_id, (y - mx) / sx AS x, (x - my) / sy AS y, y AS back_x, x AS back_y FROM cells, s"))
def coord_zscore_batch(spark, d):
    """Another layout of the cells (axes exchanged) on the scale of the true one, and brought back by the inverse."""
    cells = B.dense_cells(spark, d)
    scale = R.coordinate_scale(cells, ["x", "y"])
    other = cells.select("cell_id", F.col("y").alias("x"), F.col("x").alias("y"))
    z = R.scaled(other, scale, ["x", "y"])
    back = R.scaled(z, scale, ["x", "y"], back=True).select("cell_id", F.col("x").alias("back_x"), F.col("y").alias("back_y"))
    return z.join(back, "cell_id")


@query("SELECT DISTINCT p_type AS name, replace(replace(p_name, ' ', '_'), '/', '_') AS safe FROM part")
def safe_names(spark, d):
    return B.read(spark, d, "part").select(F.col("p_type").alias("name"), scalar.safe_name(F.col("p_name")).alias("safe")).distinct()
