"""Null layouts, samples and folds, checked value for value through portable hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import moran as MO
from ..operators import nulls as N
from . import sqltext as S
from .registry import near, query
from .spatial import PAIRS

K = S.key(3, "slot", "cell_id")
PERM = f"""s AS (SELECT slot, cell_id, x, y FROM cells, (SELECT unnest(generate_series(1, 5)) AS slot)),
own AS (SELECT slot, cell_id, row_number() OVER (PARTITION BY slot ORDER BY cell_id) AS r FROM s),
deal AS (SELECT slot, x, y, row_number() OVER (PARTITION BY slot ORDER BY {K}, cell_id) AS r FROM s),
slots AS (SELECT 0 AS slot, cell_id, x, y FROM cells UNION ALL SELECT slot, cell_id, x, y FROM own JOIN deal USING (slot, r))"""


@query(near("x y", f"WITH {S.CELLS}, {PERM} SELECT * FROM slots"))
def coord_permutation(spark, d):
    return N.coordinate_permutation(B.dense_cells(spark, d), 5, 3)


@query(near("x y", f"""WITH {S.CELLS}, s AS (SELECT slot, cell_id, x, y, (x + ({S.uniform(9, 'slot', "'jx'")} * 2 - 1) * 0.05e0) AS sx, (y + ({S.uniform(9, 'slot', "'jy'")} * 2 - 1) * 0.05e0) AS sy FROM cells, (SELECT unnest(generate_series(1, 4)) AS slot)),
t AS (SELECT slot, cell_id, x, y, (CAST(floor(sx / 0.1e0) AS BIGINT) + 1000000) * 2000001 + CAST(floor(sy / 0.1e0) AS BIGINT) + 1000000 AS bin FROM s),
b AS (SELECT slot, bin, avg(x) AS cx, avg(y) AS cy FROM t GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY bin) AS r FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY {S.key(9, 'slot', 'bin')}, bin) AS r FROM b)
SELECT 0 AS slot, cell_id, x, y FROM cells UNION ALL
SELECT t.slot, cell_id, x + p.cx - a.cx AS x, y + p.cy - a.cy AS y FROM t JOIN a ON a.slot = t.slot AND a.bin = t.bin JOIN p ON p.slot = a.slot AND p.r = a.r"""))
def block_permute(spark, d):
    return N.block_permutation(B.dense_cells(spark, d), 4, 9, 0.05)


@query(near("value", f"""WITH {S.dense()}, s AS (SELECT slot, cell_id FROM cells, (SELECT unnest(generate_series(1, 3)) AS slot)),
own AS (SELECT slot, cell_id, row_number() OVER (PARTITION BY slot ORDER BY cell_id) AS r FROM s),
deal AS (SELECT slot, cell_id AS donor, row_number() OVER (PARTITION BY slot ORDER BY {S.key(100003, 'slot', 'cell_id')}, cell_id) AS r FROM s)
SELECT 0 AS slot, cell_id, gene, value FROM expr UNION ALL
SELECT slot, own.cell_id, gene, value FROM own JOIN deal USING (slot, r) JOIN expr ON expr.cell_id = donor"""))
def expr_permutation(spark, d):
    """Whole vectors of measurements dealt anew among the cells."""
    e = F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("row")
    dealt = N.permute(B.dense_expr(spark, d).groupBy("cell_id").agg(e), 3, 100003, ["row"])
    return dealt.select("slot", "cell_id", F.inline("row"))


def normal_sql(axis: str) -> str:
    u1, u2 = (f"(1 - {S.uniform(4, 'slot', 'cell_id', repr(axis + k))})" for k in "ab")
    return f"least(max({axis}) OVER (), greatest(min({axis}) OVER (), {axis} + sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}) * 0.1e0 * (max({axis}) OVER () - min({axis}) OVER ())))"


@query(near("x y", f"""WITH {S.CELLS}, s AS (SELECT slot, cell_id, x, y FROM cells, (SELECT unnest(generate_series(1, 3)) AS slot))
SELECT 0 AS slot, cell_id, x, y FROM cells UNION ALL SELECT slot, cell_id, {normal_sql('x')} AS x, {normal_sql('y')} AS y FROM s"""))
def perturb_coords(spark, d):
    return N.perturb(B.dense_cells(spark, d), 3, 4, 0.1)


@query(f"""WITH {S.CELLS}, g AS (SELECT fraction, draw, greatest(1, least(n - 1, CAST(round_even(fraction * n, 0) AS BIGINT))) AS size FROM (SELECT unnest([0.5e0, 0.75e0]) AS fraction), (SELECT unnest([0, 1]) AS draw), (SELECT count(*) AS n FROM cells)),
r AS (SELECT fraction, draw, size, cell_id, row_number() OVER (PARTITION BY fraction, draw ORDER BY {S.key(8, 'fraction', 'draw', 'cell_id')}, cell_id) AS r FROM cells, g)
SELECT fraction, draw, cell_id FROM r WHERE r <= size""")
def subset_masks(spark, d):
    return N.subset_masks(B.dense_cells(spark, d), [0.5, 0.75], 2, 8)


@query(f"SELECT c_custkey AS cell_id, CAST(ntile(7) OVER (ORDER BY {S.key(11, 'c_custkey')}, c_custkey) - 1 AS INTEGER) AS fold FROM customer")
def kfold(spark, d):
    return N.kfold(B.count_cells(spark, d), 7, 11)


SLOT_PAIRS = PAIRS.replace("FROM cells a JOIN cells b ON", "FROM slots a JOIN slots b ON a.slot = b.slot AND").replace("SELECT a.cell_id", "SELECT a.slot, a.cell_id").format(r="0.03e0")


@query(near("moran", f"""WITH {S.dense()}, {PERM}, {SLOT_PAIRS}, m AS (SELECT slot, quantile_cont(d, 0.5) AS m FROM pairs GROUP BY 1),
w1 AS (SELECT slot, i, j, 1 / greatest(d, greatest(m * 1e-4, 1e-9)) AS w FROM pairs JOIN m USING (slot)), w AS (SELECT * FROM w1 UNION ALL SELECT slot, j, i, w FROM w1),
z AS (SELECT cell_id, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM expr), q AS (SELECT gene, count(*) AS n, sum(z * z) AS q FROM z GROUP BY 1), s AS (SELECT slot, sum(w) AS s0 FROM w GROUP BY 1),
c AS (SELECT slot, a.gene, sum(w * a.z * b.z) AS c FROM w JOIN z a ON a.cell_id = w.i JOIN z b ON b.cell_id = w.j AND a.gene = b.gene GROUP BY 1, 2)
SELECT slot, avg(n / s0 * c / q) AS moran FROM c JOIN q USING (gene) JOIN s USING (slot) GROUP BY 1""".replace("), s AS (SELECT slot, sum", "), s0 AS (SELECT slot, sum").replace("JOIN s USING (slot) GROUP", "JOIN s0 USING (slot) GROUP")))
def moran_slots(spark, d):
    return MO.moran_slots(N.coordinate_permutation(B.dense_cells(spark, d), 5, 3), B.dense_expr(spark, d), 0.03)


@query(near("stat_true", f"WITH {S.CELLS}, {PERM} SELECT count(*) AS n_rows, count(DISTINCT slot) AS n_slots, avg(x) AS stat_true FROM slots"))
def slot_counts(spark, d):
    """Size of a slot batch; means do not change under permutation."""
    s = N.coordinate_permutation(B.dense_cells(spark, d), 5, 3)
    return s.agg(F.count("*").alias("n_rows"), F.countDistinct("slot").alias("n_slots"), F.avg("x").alias("stat_true"))
