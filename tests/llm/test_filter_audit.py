"""The filter audit against playing out every order."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from spatialq.llm import filter_audit, queries

TEXTS = [
    None, "", "short", "w " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)),
    "# " + " ".join(f"w{i}" for i in range(70)), "SHOUT " * 55, "a\x0bb\x0cc\td | " * 30, "ä" * 4000 + " x" * 80, "w " * 60, "#",
]


def fails(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]


def played(docs, labels):
    """Every order of the filters applied in turn, and the sums over all orders."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        f = dict(zip("ABCD", fails(t or ""))) | {"E": i is not None and i > first[t or ""]}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((part or "", f, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, c in enumerate(order, 1):
                gone = [r for r in left if r[1][c]]
                left = [r for r in left if not r[1][c]]
                mine = [r for r in rows if r[0] == part]
                total[part, c] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(r[1][c] for r in mine) - len(gone), sum(r[1][c] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_playing_every_order(spark, tmp_path):
    docs = [(i, t, ["a", "b", None, ""][i % 4]) for i, t in enumerate(TEXTS)]
    docs += [(4, TEXTS[4], "a"), (4, TEXTS[4], "b"), (None, TEXTS[4], "b"), (None, None, "c"), (1, "short", "a")] + [(50 + i, "copy", "h") for i in range(40)]
    labels = [(4, 1, 0), (4, None, 1), (5, 1, None), (2, 0, 1), (None, 1, 1), (52, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("x")).withColumn("TEXT ", F.lit(1)).withColumn("n", F.lit(2))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op12_filter_audit(spark, str(tmp_path)).collect()
    want = played(docs, labels)
    assert len(got) == len(want) == 5 * 600
    assert set(map(tuple, got)) == want


def test_potentials_of_a_known_game(spark):
    # v(S) = |S|^2: the Shapley value of each of n players is n
    v = spark.range(1).select(F.array(*(F.lit(bin(s).count("1") ** 2).cast("bigint") for s in range(8))).alias("v"))
    p = v.select(filter_audit.potentials(F.col("v"), 3)).first()[0]
    assert p[0] == 0 and all(p[7] - p[7 - b] == 3 * 6 for b in (1, 2, 4))


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.shapley for r in rows} == {0, 120}
