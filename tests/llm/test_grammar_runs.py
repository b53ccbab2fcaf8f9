"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialq.llm import grammar_runs, queries

SPACE = " \t\n\x0b\x0c\r"


def runs_reference(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(q % d == 0 and w[s : e - d] == w[s + d : e] for d in range(1, q)):
                found.append((s, e, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def pieces(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
        out += (unit * rng.randint(1, 7))[: rng.randint(1, 40)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [rng.choice([pieces(rng, rng.randint(0, 80)), [rng.randint(0, 1) for _ in range(rng.randint(0, 50))], [1] * rng.randint(0, 60)]) for _ in range(rng.randint(1, 5))]
        edges = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in grammar_runs.find_runs(np.array(sum(docs, []), np.int64), edges)), strict=True))
        want = [(s + o, e + o, q) for o, d in zip(edges.tolist(), docs) for s, e, q in runs_reference(d)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_grammar_derives_its_texts():
    rng = random.Random(9)
    ids = np.array(pieces(rng, 500), np.int64)
    edges = np.array([0, 120, 120, 121, 400, len(ids)])
    rule, s, m, e = grammar_runs.grammar(ids, edges)
    assert len(rule) == sum(max(0, n - 1) for n in np.diff(edges))  # one node for every boundary between words
    assert ((s < m) & (m < e)).all()
    told = {}
    for r, a, b, c in zip(rule.tolist(), s.tolist(), m.tolist(), e.tolist()):
        assert told.setdefault(r, (ids[a:c].tolist(), b - a)) == (ids[a:c].tolist(), b - a)
    assert len(told) < len(rule) / 2


def test_stretches_are_compared_whole():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 50, 37), 20)
    h = grammar_runs.Hashes(ids)
    i, n = rng.integers(0, 300, 200), rng.integers(0, 200, 200)
    j = i + rng.integers(1, 200, 200)
    assert h.equal(i, j, n).tolist() == [ids[a : a + k].tolist() == ids[b : b + k].tolist() for a, b, k in zip(i, j, n)]


def result_reference(doc_id, text):
    w = [x for x in _split(text or "") if x]
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_reference(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return text.split(" ")


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "a b " * 40, "ß " * 3000, "x" * 5000, "a\tb\x0bc\x0cd\re\nf\x1cg\x85h i " * 5, "a b " * 40]
    texts += [" ".join(f"w{i}" for i in pieces(rng, rng.randint(0, 90))) for _ in range(60)]
    texts.append(" ".join(f"v{rng.randint(0, 400)}" for _ in range(1500)) + " again and again" * 30)
    ids = [None, *range(len(texts) - 2), 3]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("TEXT ", F.lit("z"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [result_reference(i, t) for i, t in zip(ids, texts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)


def test_very_long_and_empty_inputs(spark):
    df = spark.createDataFrame([(1, "ha " * 200_000), (2, "a b c d e " * 30_000 + "end")], "doc_id long, text string")
    got = {r.doc_id: r for r in grammar_runs.runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "ha"
    assert [tuple(x) for x in got[2].runs] == [(0, 150_000, 5)] and got[2].collapsed == "a b c d e end"
    assert grammar_runs.runs(df.limit(0)).count() == 0
