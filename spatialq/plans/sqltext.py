"""SQL forms of the bindings, shared by the checks."""


def dense(genes: int = 62) -> str:
    return (
        "cells AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS cell_type FROM embeddings), "
        "expr AS (SELECT vec_id AS cell_id, 'g' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS gene, embedding[i]::DOUBLE AS value "
        f"FROM embeddings, (SELECT unnest(generate_series(3, {genes + 2})) AS i))"
    )


CELLS = "cells AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS cell_type FROM embeddings)"
COUNTS = (
    "cells AS (SELECT c_custkey AS cell_id, c_acctbal AS x, 400e0 * c_nationkey AS y, c_mktsegment AS cell_type FROM customer), "
    "expr AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
)
POINTS = "cells AS (SELECT event_id AS cell_id, (epoch_us(ts) - 1704067200000000) / 3600000000e0 AS x, value AS y, event_type AS cell_type FROM events)"
STUDY = (
    "study AS (SELECT o_orderkey AS run_id, o_orderpriority AS condition, o_orderstatus AS truth, "
    "((o_orderkey * 7919) % 1000 + 1) / 1001e0 AS p_value, o_totalprice AS stat FROM orders)"
)
SETS = "sets AS (SELECT DISTINCT p_type AS pathway, p_brand AS gene FROM part)"
#: cells x genes with absent counts as 0.
GRID = (
    "dense AS (SELECT c.cell_id, g.gene, coalesce(e.value, 0e0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g "
    "LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"
)


def key(seed: int, *parts: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def uniform(seed: int, *parts: str) -> str:
    return f"(CAST('0x' || substr({key(seed, *parts)}, 1, 8) AS BIGINT) / 4294967296e0)"
