"""Spatial joins, tilings, autocorrelation and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import moran as MO
from ..operators import spatial as SP
from ..operators.tiles import neighbour_counts
from . import sqltext as S
from .registry import near, query

PAIRS = "pairs AS (SELECT a.cell_id AS i, b.cell_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {r})"
R = 0.03


def pairs(r: float) -> str:
    return PAIRS.format(r=f"{r}::DOUBLE")


@query(near("d", f"WITH {S.CELLS}, {pairs(R)} SELECT * FROM pairs"))
def radius_pairs(spark, d):
    return SP.radius_pairs(B.dense_cells(spark, d), R)


KNN = """nn AS (SELECT a.cell_id AS i, b.cell_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM nn)"""


@query(near("d", f"WITH {S.CELLS}, {KNN} SELECT * FROM knn WHERE rank <= 6"))
def knn(spark, d):
    return SP.knn(B.dense_cells(spark, d), 6)


@query(near("eps", f"WITH {S.CELLS}, {KNN} SELECT quantile_cont(d, 0.9) * 1.5 AS eps FROM knn WHERE rank = 1"))
def auto_eps(spark, d):
    return SP.auto_eps(B.dense_cells(spark, d), 0.9, 1.5)


@query(near("d", f"""WITH {S.CELLS}, t AS (SELECT * FROM cells WHERE cell_id % 3 = 0), c AS (SELECT * FROM cells WHERE cell_id % 3 <> 0),
m AS (SELECT t.cell_id, c.cell_id AS match_id, sqrt((t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y)) AS d FROM t JOIN c ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, match_id) AS r FROM m WHERE d <= 0.05)
SELECT t.cell_id, match_id, d FROM t LEFT JOIN r ON t.cell_id = r.cell_id AND r.r = 1"""))
def nearest_match(spark, d):
    c = B.dense_cells(spark, d)
    return SP.nearest_match(c.filter("cell_id % 3 = 0"), c.filter("cell_id % 3 <> 0"), 0.05)


CENTERS = [(0, 0.0, 0.0), (1, 0.1, 0.1), (2, -0.1, 0.05), (3, 0.0, -0.2)]


@query(near("d", f"""WITH {S.CELLS}, c AS (SELECT * FROM (VALUES (0, 0e0, 0e0), (1, 0.1e0, 0.1e0), (2, -0.1e0, 0.05e0), (3, 0e0, -0.2e0)) v(center, cx, cy)),
m AS (SELECT cell_id, center, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM cells, c)
SELECT cell_id, center, d, d < 0.1 AS inside FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, center) AS r FROM m) WHERE r = 1"""))
def nearest_center(spark, d):
    return SP.nearest_center(B.dense_cells(spark, d), CENTERS).withColumn("inside", F.col("d") < 0.1)


BINNED = """b AS (SELECT cell_id, (CAST(floor((x - x0) / 2000) AS BIGINT) + 1000000) * 2000001 + CAST(floor((y - y0) / 2000) AS BIGINT) + 1000000 AS bin,
  (floor((x - x0) / 2000) + 0.5) * 2000 + x0 AS bx, (floor((y - y0) / 2000) + 0.5) * 2000 + y0 AS cy FROM cells, (SELECT min(x) AS x0, min(y) AS y0 FROM cells))"""


@query(near("x y value", f"""WITH {S.COUNTS}, {BINNED}, n AS (SELECT bin, any_value(bx) AS x, any_value(cy) AS y, count(*) AS n_cells FROM b GROUP BY 1)
SELECT bin, x, y, gene, sum(value) AS value, n_cells FROM b JOIN expr USING (cell_id) JOIN n USING (bin) GROUP BY ALL"""))
def binning_square(spark, d):
    return SP.bin_cells(B.count_cells(spark, d), lambda binned: B.count_rows(spark, d, binned), 1000.0)


@query(near("x y value", f"""WITH {S.COUNTS}, o AS (SELECT min(x) AS x0, min(y) AS y0 FROM cells),
h AS (SELECT cell_id, cell_type, (0.5773502691896257e0 * (x - x0) - (1e0 / 3) * (y - y0)) / 1000 AS q, (2e0 / 3) * (y - y0) / 1000 AS r FROM cells, o),
k AS (SELECT cell_id, cell_type, q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM h),
f AS (SELECT cell_id, cell_type, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS q,
  CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s)) AND abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS r FROM k),
b AS (SELECT cell_id, cell_type, (CAST(q AS BIGINT) + 1000000) * 2000001 + CAST(r AS BIGINT) + 1000000 AS bin,
  (1.7320508075688772e0 * q + 0.8660254037844386e0 * r) * 1000 + x0 AS bx, 1.5e0 * r * 1000 + y0 AS cy FROM f, o),
n AS (SELECT cell_type, bin, any_value(bx) AS x, any_value(cy) AS y, count(*) AS n_cells FROM b GROUP BY 1, 2)
SELECT cell_type, bin, x, y, gene, sum(value) AS value, n_cells FROM b JOIN expr USING (cell_id) JOIN n USING (cell_type, bin) GROUP BY ALL"""))
def binning_hex(spark, d):
    """Pseudo-spots by cell type."""
    return SP.bin_cells(B.count_cells(spark, d), lambda binned: B.count_rows(spark, d, binned), 1000.0, "hexagon", ("cell_type",))


@query(near("mean_cells median_cells singleton_share", f"""WITH {S.POINTS}, n AS (SELECT floor(x / 50) AS i, floor(y / 50) AS j, count(*) AS n FROM cells GROUP BY ALL)
SELECT count(*) AS n_blocks, avg(n) AS mean_cells, quantile_cont(n, 0.5) AS median_cells, min(n) AS min_cells, max(n) AS max_cells, avg(CASE WHEN n = 1 THEN 1e0 ELSE 0 END) AS singleton_share FROM n"""))
def block_stats(spark, d):
    return SP.block_stats(B.points(spark, d), 25.0)


@query(near("lam ux uy", f"""WITH {S.CELLS}, m AS (SELECT var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM cells),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS lam FROM m)
SELECT lam, abs(b) / sqrt(b * b + (lam - a) ** 2) AS ux, sign(b) * (lam - a) / sqrt(b * b + (lam - a) ** 2) AS uy FROM l"""))
def principal_axis(spark, d):
    return SP.principal_axis(B.dense_cells(spark, d))


WEIGHTS = """m AS (SELECT quantile_cont(d, 0.5) AS m FROM pairs), w1 AS (SELECT i, j, 1 / greatest(d, greatest(m * 1e-4, 1e-9)) AS w FROM pairs, m),
w AS (SELECT * FROM w1 UNION ALL SELECT j, i, w FROM w1)"""


@query(near("moran", f"""WITH {S.dense()}, {pairs(R)}, {WEIGHTS}, z AS (SELECT cell_id, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM expr),
c AS (SELECT a.gene, sum(w * a.z * b.z) AS c FROM w JOIN z a ON a.cell_id = w.i JOIN z b ON b.cell_id = w.j AND a.gene = b.gene GROUP BY 1)
SELECT gene, count(*) / (SELECT sum(w) FROM w) * any_value(c) / sum(z * z) AS moran FROM z JOIN c USING (gene) GROUP BY 1"""))
def morans_i(spark, d):
    return MO.morans_i(B.dense_cells(spark, d), B.dense_expr(spark, d), R)


@query(near("distance covariance gamma", f"""WITH {S.dense()}, {pairs(0.06)}, z AS (SELECT cell_id, gene, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS z FROM expr)
SELECT CAST(least(floor(d / (0.06e0 / 6)), 5) AS INTEGER) AS bin, count(DISTINCT (i, j)) AS n_pairs, avg(d) AS distance, avg(a.z * b.z) AS covariance, 1 - avg(a.z * b.z) AS gamma
FROM pairs JOIN z a ON a.cell_id = i JOIN z b ON b.cell_id = j AND a.gene = b.gene GROUP BY 1"""))
def variogram(spark, d):
    return MO.variogram(B.dense_cells(spark, d), B.dense_expr(spark, d), 0.06, 6)


@query(near("half_length", f"""WITH {S.dense()}, {pairs(0.06)}, z AS (SELECT cell_id, gene, (value - avg(value) OVER (PARTITION BY gene)) / (stddev_pop(value) OVER (PARTITION BY gene) + 1e-8) AS z FROM expr),
v AS (SELECT least(floor(d / (0.06e0 / 6)), 5) AS bin, avg(d) AS distance, avg(a.z * b.z) AS c FROM pairs JOIN z a ON a.cell_id = i JOIN z b ON b.cell_id = j AND a.gene = b.gene GROUP BY 1)
SELECT min(distance) AS half_length FROM v WHERE c <= 0.5 * (SELECT max(c) FROM v)"""))
def autocorr_length(spark, d):
    """The distance of the first bin whose covariance is at most half the largest."""
    v = MO.variogram(B.dense_cells(spark, d), B.dense_expr(spark, d), 0.06, 6)
    top = v.agg(F.max("covariance").alias("_t"))
    return v.crossJoin(F.broadcast(top)).filter(F.col("covariance") <= 0.5 * F.col("_t")).agg(F.min("distance").alias("half_length"))


@query(f"""WITH {S.CELLS}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM cells)
SELECT CAST(least(floor((x - a) / (b - a) * 12), 11) AS BIGINT) AS bx, CAST(least(floor((y - c) / (d - c) * 12), 11) AS BIGINT) AS by, count(*) AS n FROM cells, e GROUP BY 1, 2""")
def density_2d(spark, d):
    return SP.density(B.dense_cells(spark, d), 12)


@query(near("smoothness", """WITH g AS (SELECT l_quantity AS gx, l_linenumber AS gy, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT v - lag(v) OVER (PARTITION BY gy ORDER BY gx) AS dx, v - lag(v) OVER (PARTITION BY gx ORDER BY gy) AS dy FROM g)
SELECT sum(coalesce(dx * dx, 0) + coalesce(dy * dy, 0)) AS smoothness FROM a"""))
def grid_smoothness(spark, d):
    """Squared forward differences along both axes of a grid."""
    from pyspark.sql import Window

    g = B.read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("gx"), F.col("l_linenumber").alias("gy")).agg(F.avg("l_discount").alias("v"))
    dx = F.col("v") - F.lag("v").over(Window.partitionBy("gy").orderBy("gx"))
    dy = F.col("v") - F.lag("v").over(Window.partitionBy("gx").orderBy("gy"))
    return g.select(dx.alias("dx"), dy.alias("dy")).agg(F.sum(F.coalesce(F.col("dx") * F.col("dx"), F.lit(0.0)) + F.coalesce(F.col("dy") * F.col("dy"), F.lit(0.0))).alias("smoothness"))


CORE = f"""WITH {S.CELLS}, {pairs(R)}, deg AS (SELECT i, count(*) + 1 AS n FROM (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs) GROUP BY 1)"""


@query(f"{CORE} SELECT cell_id, coalesce(n, 1) >= 4 AS core FROM cells LEFT JOIN deg ON i = cell_id")
def dbscan_core(spark, d):
    c = B.dense_cells(spark, d)
    return c.join(neighbour_counts(c, R), "cell_id", "left").select("cell_id", (F.coalesce(F.col("n") + 1, F.lit(1)) >= 4).alias("core"))


CLUSTERS = f"""WITH RECURSIVE {S.CELLS}, {pairs(R)}, both_ AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs), deg AS (SELECT i, count(*) + 1 AS n FROM both_ GROUP BY 1),
core AS (SELECT i FROM deg WHERE n >= 4), link AS (SELECT b.i, b.j FROM both_ b JOIN core a ON a.i = b.i JOIN core c ON c.i = b.j),
reach AS (SELECT i AS v, i AS r FROM core UNION SELECT link.j, reach.r FROM reach JOIN link ON link.i = reach.v),
root AS (SELECT v, min(r) AS root FROM reach GROUP BY 1), side AS (SELECT b.i, min(root) AS root FROM both_ b JOIN root ON root.v = b.j GROUP BY 1),
ids AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)),
cl AS (SELECT cell_id, coalesce(cluster, -1) AS cluster FROM cells LEFT JOIN root ON v = cell_id LEFT JOIN side ON side.i = cell_id LEFT JOIN ids ON ids.root = coalesce(root.root, side.root))"""


@query(f"{CLUSTERS} SELECT * FROM cl")
def dbscan(spark, d):
    return SP.dbscan(B.dense_cells(spark, d), R, 4)


@query(f"""{CLUSTERS}, s AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS region FROM cl WHERE cluster >= 0 GROUP BY cluster HAVING count(*) >= 3)
SELECT cell_id, region FROM cl JOIN s USING (cluster)""")
def region_relabel(spark, d):
    return SP.relabel_by_size(SP.dbscan(B.dense_cells(spark, d), R, 4), 3)


@query(f"""WITH RECURSIVE {S.CELLS}, link0 AS (SELECT a.cell_id AS i, b.cell_id AS j FROM cells a JOIN cells b ON a.cell_type = b.cell_type AND a.cell_id <> b.cell_id
  AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.06),
reach AS (SELECT cell_id AS v, cell_id AS r FROM cells UNION SELECT link0.j, reach.r FROM reach JOIN link0 ON link0.i = reach.v),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY 1), own AS (SELECT cells.*, c FROM cells JOIN comp ON v = cell_id),
best AS (SELECT cell_type, c, count(*) AS n, row_number() OVER (PARTITION BY cell_type ORDER BY count(*) DESC, c) AS r FROM own GROUP BY 1, 2)
SELECT own.cell_id, own.cell_type FROM own JOIN best ON best.cell_type = own.cell_type AND best.r = 1 WHERE best.n = 1 OR own.c = best.c""")
def spatial_denoise(spark, d):
    return SP.denoise(B.dense_cells(spark, d), 0.06).select("cell_id", "cell_type")


@query(f"""{CLUSTERS}, m AS (SELECT cluster, row_number() OVER (ORDER BY avg(x), cluster) - 1 AS place, count(*) OVER () AS k FROM cl JOIN cells USING (cell_id) WHERE cluster >= 0 GROUP BY cluster)
SELECT cell_id FROM cl JOIN m USING (cluster) WHERE place = k // 2""")
def middle_region(spark, d):
    """Cells of the cluster in the middle along x."""
    from pyspark.sql import Window

    c = B.dense_cells(spark, d)
    cl = SP.dbscan(c, R, 4).filter("cluster >= 0")
    m = cl.join(c, "cell_id").groupBy("cluster").agg(F.avg("x").alias("mx"))
    w = Window.orderBy("mx", "cluster")
    m = m.select("cluster", (F.row_number().over(w) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("k"))
    return cl.join(m.filter(F.col("place") == F.floor(F.col("k") / 2)), "cluster").select("cell_id")


@query(near("cx cy", f"""WITH RECURSIVE {S.POINTS}, px AS (SELECT DISTINCT CAST(floor(y / 20) AS BIGINT) AS r, CAST(floor(x / 12) AS BIGINT) AS c FROM cells),
reach AS (SELECT r, c, r * 2147483648 + c AS root FROM px UNION SELECT px.r, px.c, reach.root FROM reach JOIN px ON abs(px.r - reach.r) + abs(px.c - reach.c) = 1),
own AS (SELECT r, c, min(root) AS root FROM reach GROUP BY 1, 2), n AS (SELECT root, count(*) AS n_pixels, avg(c) AS cx, avg(r) AS cy FROM own GROUP BY 1 HAVING count(*) >= 2)
SELECT row_number() OVER (ORDER BY root) - 1 AS object, n_pixels, cx, cy FROM n"""))
def mask_objects(spark, d):
    """Objects of at least two pixels in the mask of places where events fall."""
    from ..operators.masks import mask_objects as objects

    p = B.points(spark, d).select(F.floor(F.col("y") / 20).alias("row"), F.floor(F.col("x") / 12).alias("col"))
    return objects(p, 2).withColumn("object", F.col("object").cast("bigint"))


NEXT = """d{r} AS (SELECT cell_id, c.x, c.y, min((c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y)) AS d2 FROM cells c, f{p} f GROUP BY ALL),
f{r} AS (SELECT x, y FROM f{p} UNION SELECT x, y FROM d{r}, (SELECT sum(d2) AS t FROM d{r}) WHERE {u} < d2 * 8 / t)"""
SEEDS = f"""WITH RECURSIVE {S.CELLS}, f0 AS (SELECT x, y FROM cells ORDER BY {S.key(3, 'cell_id')}, cell_id LIMIT 1),
{", ".join(NEXT.format(r=r, p=r - 1, u=S.uniform(3, str(r), 'cell_id')) for r in (1, 2, 3))},
w AS (SELECT x, y, count(*) AS n FROM (SELECT f.x, f.y FROM cells c, f3 f QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY (c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y)) = 1) GROUP BY 1, 2),
t AS ((SELECT 0 AS center, x, y, [x] AS xs, [y] AS ys FROM w ORDER BY n DESC, x, y LIMIT 1)
  UNION ALL SELECT center + 1, w.x, w.y, list_append(xs, w.x), list_append(ys, w.y) FROM t, w WHERE center < 3
  QUALIFY row_number() OVER (ORDER BY n * list_min(list_transform(range(1, len(xs) + 1), lambda i: (w.x - xs[i]) ** 2 + (w.y - ys[i]) ** 2)) DESC, w.x, w.y) = 1)"""


@query(near("x y", f"{SEEDS} SELECT center, x, y FROM t"))
def kmeans_seeds(spark, d):
    """Four starting centres by deterministic oversampling."""
    found = SP.kmeans_seeds(B.dense_cells(spark, d), 4, 3)
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(found)], "center int, x double, y double")


@query(near("x y", f"""{SEEDS}, a AS (SELECT cells.x, cells.y, center FROM cells, t QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY (cells.x - t.x) ** 2 + (cells.y - t.y) ** 2, center) = 1)
SELECT center, avg(x) AS x, avg(y) AS y, count(*) AS n FROM a GROUP BY 1"""))
def kmeans_step(spark, d):
    """The centres after one round, and their cells."""
    cells = B.dense_cells(spark, d)
    return spark.createDataFrame(SP.lloyd_step(cells, SP.kmeans_seeds(cells, 4, 3)), "center int, x double, y double, n long")
