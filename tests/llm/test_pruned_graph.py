"""Nearest neighbours on pruned graphs against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialq.llm import pruned_graph

KIND = "vec_id long, embedding array<float>"


def clumped(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = rng.normal(size=(n, dim))
    near = rng.random(n) < 0.5
    x[near] = centres[rng.integers(0, 8, near.sum())] + 0.05 * x[near]
    x[: n // 4] *= rng.random((n // 4, 1)) * 3
    return x.astype(np.float32).astype(float)


def product(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def exact_reference(rows, k, every):
    out = {}
    for i, x in rows:
        if i % every == 0:
            scored = [(-product(x, y), j) for j, y in rows if j != i]
            out[i] = sorted(scored)[:k]
    return out


def test_greedy_search_and_pruning_keep_recall():
    x = clumped(1500, 24, 1)
    graph, entries = pruned_graph.build_graph(pruned_graph.unit(x))
    assert graph.shape == (1500, pruned_graph.DEGREE) and pruned_graph.reachable(graph, entries.tolist()).all()
    for node in range(0, 1500, 100):
        own = graph[node][graph[node] >= 0]
        assert len(set(own)) == len(own) and node not in own
    q = np.concatenate([x[::10], np.zeros((150, 1))], 1).astype(np.float32)
    ids, _ = pruned_graph.beam_search(pruned_graph.unit(x), graph, entries, q, pruned_graph.BEAM)
    true = np.argsort(-(x[::10] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, true)]) > 0.95


def test_pruning_drops_what_a_nearer_neighbour_covers():
    t = np.array([0.0, 0.10, 0.12, 0.9, -0.3])
    x = np.stack([np.cos(t), np.sin(t)], 1).astype(np.float32)
    ids = np.array([[1, 2, 4, 3]], np.int32)
    near = (x[ids[0]] @ x[0])[None]
    assert pruned_graph.prune(x, np.array([0]), ids, near, 3, 1.0).tolist() == [[1, 4, -1]]
    assert pruned_graph.prune(x, np.array([0]), ids, near, 3, 1.2).tolist() == [[1, 4, 3]]  # 1.2 * 0.8 > 0.9


@pytest.mark.parametrize("shard_rows", [100_000, 150])
def test_recall_over_shards(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(pruned_graph, "QUERY_ROWS", 20)
    monkeypatch.setattr(pruned_graph, "MERGE", 2)
    x = clumped(900, 16, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, KIND).withColumn("shard", F.lit("q")).withColumn("Embedding ", F.lit(1))
    got = {}
    for r in pruned_graph.nearest(df, shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact_reference(rows, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        score = {j: -s for s, j in exact_reference([(i, x[i].tolist()), *((j, x[j].tolist()) for j in {r.vec_id for r in found})], 99, 20)[i]}
        assert [(r.score, r.vec_id) for r in found] == sorted(((score[r.vec_id], r.vec_id) for r in found), key=lambda s: (-s[0], s[1]))
        hits += len({r.vec_id for r in found} & {j for _, j in want[i]})
    assert hits >= 0.95 * 20 * len(want)


def test_odd_rows_ties_and_copies(spark):
    good = [(i, [1.0, 0.0, 0.5]) for i in range(1, 60)] + [(20, [0.0, 1.0, 0.0]), (40, [3.0, 0.0, 0.0]), (0, [-1.0, -1.0, -1.0])]
    odd = [(60, None), (80, []), (100, [0.0, 0.0, 0.0]), (120, [1.0, None, 0.0]), (140, [math.nan, 1.0, 1.0]), (160, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    pair = [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (220, [0.0, 5.0])]
    rows = good + pair
    df = spark.createDataFrame(rows + odd + [good[0], good[0], pair[0]], KIND)
    got = pruned_graph.nearest(df, k=20, shard_rows=25).collect()
    groups = [[r for r in rows if len(r[1]) == n] for n in (3, 2)]
    want = set()
    for group in groups:
        # several vectors may carry one id; each of them is asked
        for i, x in group:
            if i % 20 == 0:
                scored = sorted((-product(x, y), j) for j, y in group if j != i)[:20]
                want |= {(i, j, -s + 0.0) for s, j in scored}
    assert {(r.query_id, r.vec_id, r.score) for r in got if r.query_id not in (20, 40)} == {w for w in want if w[0] not in (20, 40)}
    assert {r.query_id for r in got} == {0, 20, 40, 200, 220}


def test_empty_table_and_single_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert pruned_graph.nearest(empty).count() == 0
    assert pruned_graph.nearest(spark.createDataFrame([(20, [1.0])], KIND)).count() == 0
    two = pruned_graph.nearest(spark.createDataFrame([(20, [1.0, 2.0]), (7, [1e30, -1e30])], KIND)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(20, 1, 7)]
