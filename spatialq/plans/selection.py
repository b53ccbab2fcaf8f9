"""Scans, filters and joins of cells and genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import genes as G
from ..operators import rows as R
from . import sqltext as S
from .registry import near, query


@query(near("x y", f"WITH {S.CELLS} SELECT * FROM cells"))
def scan_cells(spark, d):
    return B.dense_cells(spark, d)


@query(near("x y", "SELECT c_custkey AS cell_id, coalesce(c_acctbal, 0e0) AS x, coalesce(c_nationkey, 0) * 400e0 AS y FROM customer"))
def coords(spark, d):
    """Coordinates by priority: the named columns first, else the fallback."""
    c = B.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell_id"), F.coalesce("c_acctbal", F.lit(0.0)).alias("x"), (F.coalesce("c_nationkey", F.lit(0)) * 400.0).alias("y"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE CAST(c_mktsegment AS VARCHAR) = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) = '7'")
def obs_filter_eq(spark, d):
    return R.filter_equal(B.read(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 7}).select("c_custkey", "c_mktsegment")


@query(near("c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000 AND c_nationkey <> 3"))
def obs_filter_range(spark, d):
    wanted = {"c_acctbal": {"ge": 1000, "lt": 5000}, "c_nationkey": {"ne": 3}}
    return R.filter_range(B.read(spark, d, "customer"), wanted).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING max(o_totalprice) IS NOT NULL")
def obs_drop_na(spark, d):
    o = B.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return R.drop_missing(B.read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left"), ["top"])


@query("SELECT c_custkey AS cell_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def subset_by_index(spark, d):
    index = B.read(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("cell_id"))
    return R.subset_by_index(B.count_cells(spark, d).select("cell_id"), index)


@query("SELECT p_brand AS gene FROM (SELECT DISTINCT p_brand FROM part) WHERE NOT (regexp_matches(p_brand, '^Brand#1') OR regexp_matches(p_brand, '5$'))")
def gene_exclude(spark, d):
    genes = B.read(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    return G.exclude_genes(genes, ["^Brand#1", "5$"])


PANEL = "(VALUES ('Brand#11'), ('Brand#23'), ('NOT_PRESENT'))"


def panel_of(spark):
    return spark.createDataFrame([("Brand#11",), ("Brand#23",), ("NOT_PRESENT",)], "gene string")


@query(f"WITH {S.COUNTS} SELECT gene, count(*) AS n FROM expr WHERE gene IN (SELECT * FROM {PANEL}) GROUP BY 1")
def gene_panel(spark, d):
    return G.panel(B.count_expr(spark, d), panel_of(spark)).groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {S.COUNTS} SELECT col0 AS gene FROM {PANEL} WHERE col0 NOT IN (SELECT gene FROM expr)")
def gene_panel_missing(spark, d):
    return G.panel_missing(B.count_expr(spark, d).select("gene").distinct(), panel_of(spark))


@query(f"WITH {S.COUNTS}, k AS (SELECT gene FROM expr GROUP BY 1 HAVING count(*) FILTER (value <> 0) >= (SELECT count(*) FROM cells) * 3 // 5) SELECT cell_id, gene, value FROM expr WHERE gene IN (SELECT gene FROM k)")
def gene_min_cells(spark, d):
    least = B.count_cells(spark, d).count() * 3 // 5
    return G.min_cells(B.count_expr(spark, d), least).select("cell_id", "gene", "value")


@query("""WITH k AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM customer) // 25)
SELECT c_custkey, c_nationkey, dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS code FROM customer WHERE c_nationkey IN (SELECT * FROM k)""")
def celltype_min_cells(spark, d):
    c = B.read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return R.min_group(c, "c_nationkey", c.count() // 25).select("c_custkey", "c_nationkey", "code")


@query(f"SELECT c_custkey AS cell_id FROM customer ORDER BY {S.key(42, 'c_custkey')}, c_custkey LIMIT 50")
def subsample_cells(spark, d):
    return R.subsample(B.count_cells(spark, d), 50, 42).select("cell_id")


@query(near("x y", f"""WITH {S.CELLS}, z AS (SELECT cell_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM cells)
SELECT * FROM z WHERE x > -0.5 AND x < 1 AND y >= 0"""))
def spatial_crop(spark, d):
    return R.crop(B.dense_cells(spark, d), {"x": {"gt": -0.5, "lt": 1}, "y": {"ge": 0}}).select("cell_id", "x", "y")


@query(f"WITH {S.COUNTS} SELECT gene, count(*) AS n_cells FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 10")
def gene_universe(spark, d):
    return G.universe(B.count_expr(spark, d), 10)


@query(f"SELECT gene FROM (SELECT gene FROM (SELECT DISTINCT p_brand AS gene FROM part) ORDER BY {S.key(7, 'gene')}, gene LIMIT 10) ORDER BY gene")
def random_panel(spark, d):
    return G.random_panel(B.read(spark, d, "part").select(F.col("p_brand").alias("gene")), 10, 7)


@query("""WITH g AS (SELECT DISTINCT p_brand AS gene FROM part), s AS (SELECT DISTINCT lower(p_brand) || '|alias' AS symbol FROM part UNION SELECT 'Brand#11' UNION SELECT 'none')
SELECT symbol, coalesce((SELECT gene FROM g WHERE gene = symbol), (SELECT min(gene) FROM g WHERE upper(trim(split_part(gene, '|', 1))) = upper(trim(split_part(symbol, '|', 1))))) AS gene FROM s""")
def gene_resolve(spark, d):
    genes = B.read(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    symbols = genes.select(F.concat(F.lower("gene"), F.lit("|alias")).alias("symbol"))
    symbols = symbols.unionByName(spark.createDataFrame([("Brand#11",), ("none",)], "symbol string")).distinct()
    return G.resolve(symbols, genes)


@query(near("mean dispersion score", f"""WITH {S.COUNTS}, t AS (SELECT cell_id, sum(value) AS t FROM expr GROUP BY 1 HAVING sum(value) > 0),
s AS (SELECT gene, sum(value * 1e4 / t) AS s, sum((value * 1e4 / t) * (value * 1e4 / t)) AS q, (SELECT count(*) FROM cells)::DOUBLE AS n FROM expr JOIN t USING (cell_id) GROUP BY 1),
m AS (SELECT gene, s / n AS mean, (q - s * s / n) / (n - 1) AS var FROM s),
l AS (SELECT gene, ln(1 + mean) AS mean, ln(var / mean) AS dispersion FROM m WHERE mean > 0 AND var > 0),
b AS (SELECT *, least(floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20)), 19) AS bin FROM l),
z AS (SELECT gene, mean, dispersion, CASE WHEN stddev_samp(dispersion) OVER (PARTITION BY bin) IS NULL OR stddev_samp(dispersion) OVER (PARTITION BY bin) = 0 THEN 1e0
  ELSE (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / stddev_samp(dispersion) OVER (PARTITION BY bin) END AS score FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, gene) AS rank FROM z)
SELECT * FROM r WHERE rank <= 10"""))
def hvg_seurat(spark, d):
    return G.highly_variable(B.count_expr(spark, d), B.count_cells(spark, d).count(), 10)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def assemble_cells(spark, d):
    """Attributes joined to cells; the dimension tables are a few rows."""
    n = B.read(spark, d, "nation").join(F.broadcast(B.read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return B.read(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""WITH a AS (SELECT count(*) AS n FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)),
b AS (SELECT count(*) AS n FROM customer WHERE c_custkey || '_1' IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders))
SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders
ON CASE WHEN (SELECT n FROM a) >= (SELECT n FROM b) THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '_1' END = CAST(o_custkey AS VARCHAR) GROUP BY 1""")
def join_best_key(spark, d):
    """The raw or the suffixed key, whichever matches more cells."""
    c = B.read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("raw"))
    o = B.read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.count("*").alias("n"))
    c = c.withColumn("suffixed", F.concat("raw", F.lit("_1")))
    hits = {k: c.join(o, c[k] == o["k"], "left_semi").count() for k in ("raw", "suffixed")}
    best = max(hits, key=lambda k: (hits[k], k == "raw"))
    return c.join(o, c[best] == o["k"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT p_brand AS gene, p_type AS attr, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
SELECT g.gene, a.attr FROM (SELECT DISTINCT p_brand AS gene FROM part) g LEFT JOIN a ON a.gene = g.gene AND a.r = 1""")
def gene_attr_join(spark, d):
    """The first attribute row of each gene: a least by key, not a sort of each group."""
    p = B.read(spark, d, "part")
    first = p.groupBy(F.col("p_brand").alias("gene")).agg(F.min_by("p_type", "p_partkey").alias("attr"))
    return p.select(F.col("p_brand").alias("gene")).distinct().join(first, "gene", "left")


@query("SELECT DISTINCT p_type AS pathway, upper(x) AS gene FROM (SELECT p_type, unnest(string_split(p_brand || ' ' || lower(p_brand), ' ')) AS x FROM part)")
def gmt_explode(spark, d):
    from ..sources.gmt import explode_lines

    p = B.read(spark, d, "part")
    lines = p.select(F.concat_ws("\t", "p_type", F.lit("url"), "p_brand", F.upper(F.lower("p_brand"))).alias("line"))
    return explode_lines(lines).withColumn("gene", F.upper("gene")).distinct()


@query(f"""WITH {S.COUNTS} SELECT 'c' || cell_id AS cell_id, gene, value, x, y FROM expr JOIN cells USING (cell_id) WHERE cell_type <> 'BUILDING'""")
def mtx_cells(spark, d):
    """The counts written as a compressed coordinate matrix in parts, with name files and positions, and assembled from them."""
    from ..operators.ranks import id_rank
    from ..sources import matrices as M
    from ..sources.scratch import scratch, written

    base = scratch(spark, "mtx")
    cells = B.count_cells(spark, d)
    n = cells.count()
    cells = written(id_rank(cells, [], "cell_id", n).withColumnRenamed("_r", "j"), "cells")
    genes = B.read(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    genes = written(genes.selectExpr("gene", "row_number() OVER (ORDER BY gene) AS i"), "genes")  # a dimension
    entries = B.count_expr(spark, d).join(cells.select("cell_id", "j"), "cell_id").join(genes, "gene").select("i", "j", "value")
    M.write_matrix(entries, genes.count(), n, f"{base}/matrix", "gzip")
    M.write_names(genes.select("i", F.lit("id").alias("id"), "gene", F.lit("Gene Expression").alias("kind")), "i", ["id", "gene", "kind"], f"{base}/features")
    M.write_names(cells.select("j", F.concat(F.lit("c"), F.col("cell_id")).alias("barcode")), "j", ["barcode"], f"{base}/barcodes", "gzip")
    on = (F.col("cell_type") != "BUILDING").cast("int")
    cells.select(F.concat(F.lit("c"), F.col("cell_id")), on, F.lit(0).alias("r"), F.lit(0).alias("c"), "y", "x").write.csv(f"{base}/positions")
    own, expr = M.assemble(spark, f"{base}/matrix", f"{base}/features", f"{base}/barcodes", f"{base}/positions")
    return expr.join(own.select("cell_id", "x", "y"), "cell_id")


@query(near("x", """SELECT CASE WHEN c_custkey % 7 = 3 THEN '2 of 3 fields' WHEN c_custkey % 7 = 5 THEN 'a value of another kind' ELSE 'whole' END AS reason, count(*) AS n,
  sum(CASE WHEN c_custkey % 7 IN (3, 5) THEN 0 ELSE c_acctbal END) AS x FROM customer GROUP BY 1"""))
def quarantine_scan(spark, d):
    """A written CSV with damaged lines: what was set aside and why, and what the job went on with."""
    from ..sources.results import read_quarantined
    from ..sources.scratch import scratch

    path = scratch(spark, "damaged")
    c = B.read(spark, d, "customer")
    kind = F.col("c_custkey") % 7
    line = F.when(kind == 3, F.concat_ws(",", "c_custkey", "c_acctbal")).when(kind == 5, F.concat_ws(",", "c_custkey", F.lit("n/a"), "c_nationkey")).otherwise(F.concat_ws(",", "c_custkey", "c_acctbal", "c_nationkey"))
    c.select(line.alias("value")).write.text(path)
    rows, damaged = read_quarantined(spark, path, "cell_id long, x double, nation long", header=False)
    aside = damaged.groupBy("reason").agg(F.count("*").alias("n"), F.lit(0.0).alias("x"))
    return aside.unionByName(rows.agg(F.lit("whole").alias("reason"), F.count("*").alias("n"), F.sum("x").alias("x")))
