"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt by hash to shards of about ``shard_rows``; each shard is one task's graph:

* Its distinct vectors, over the shard's largest norm, get one more coordinate that makes
  them unit vectors. A query with 0 there meets them in the order of its inner products,
  so one distance serves building and searching.
* Nodes are inserted in batches that double, from the node nearest to the mean on. A greedy
  beam search over the graph so far proposes each node's neighbours; of these, nearest
  first, a neighbour p drops every later c with ``alpha * d(p, c) <= d(node, c)``, so that
  the at most ``degree`` edges point in different directions. The edges are also made
  backwards; a node with too many is pruned in the same way. A second pass goes over the
  finished graph. Where norms differ, long vectors answer most queries and yet are far from
  all nodes, so half of a node's edges go to what a search for the node as a query proposes.
* Searches begin at ``ENTRIES`` nodes; parts that cannot be reached from them get an entry of their own.

The graphs are an index, written as a table of one row a shard. Queries go in blocks to
every shard, a beam search finds ``beam`` nodes in each, and their scores are computed anew
in double precision from the vectors as given. The shards' best are merged in steps of
``MERGE`` shards, so no group grows with the number of shards.

Work: building is linear in the rows. Every query visits every shard, which is queries x
rows / shard_rows searches of about ``beam * degree`` products; a larger ``shard_rows``
lowers it where executors have the memory.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without vec_id, take no part; vectors meet only those of their own length; rows
alike in vec_id and vector count once; a query's own rows are all those of its vec_id;
equal vectors are one node that knows its smallest k + 1 ids, which is all that k results
can name; ties go to the smaller vec_id; with k candidates or fewer all are found; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

SHARD_ROWS = 4096
QUERY_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 80
BEAM = 128
ALPHA = 1.1
#: Nodes where searches begin: the one nearest to the mean and random ones, for a mean may lie in a clump that fills a beam.
ENTRIES = 16
#: How many shards' answers to a query one group merges.
MERGE = 64
#: Nodes expanded at once in a step of a beam search.
WIDTH = 4
#: Rows of a beam search or a pruning that are held at once.
CHUNK = 256


def dots(x: np.ndarray, at: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x[at], q[row])


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, products) of the beam of each query, best first; -1 where a beam is not full."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n), bool)
    seen[:, entries] = True
    first = q @ x[entries].T
    ids = np.full((b, beam), -1, np.int32)
    near = np.full((b, beam), -np.inf, np.float32)
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    m = order.shape[1]
    ids[:, :m], near[:, :m] = entries[order], np.take_along_axis(first, order, 1)
    done = ids < 0
    live = np.arange(b)
    while len(live):
        fresh = ~done[live]
        rank = np.cumsum(fresh, axis=1)
        take = fresh & (rank <= WIDTH)
        busy = take.any(1)
        live, take, rank = live[busy], take[busy], rank[busy]
        if not len(live):
            break
        r, c = np.nonzero(take)
        cur = np.full((len(live), WIDTH), -1, np.int32)
        cur[r, rank[r, c] - 1] = ids[live[r], c]
        done[live[r], c] = True
        next_ = graph[cur]
        next_[cur < 0] = -1
        next_ = np.sort(next_.reshape(len(live), -1), axis=1)
        new = next_ >= 0
        new[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        new &= ~seen[live[:, None], next_]
        r, c = np.nonzero(new)
        found = next_[r, c]
        seen[live[r], found] = True
        score = np.full(next_.shape, -np.inf, np.float32)
        score[r, c] = dots(x, found, q, live[r])
        next_[~new] = -1
        all_ids = np.concatenate([ids[live], next_], 1)
        all_near = np.concatenate([near[live], score], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[live], near[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_near, all_done))
    return ids, near


def prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(rows, degree) ids of diverse neighbours for each of the nodes ``own``, -1 where there are fewer.

    ids, near: candidates and their products with the node, best first, -1 for none.
    Distances of unit vectors are compared squared, 2 - 2 products.
    """
    b = np.arange(len(own))
    alive = (ids >= 0) & (ids != own[:, None])
    points = x[ids]
    between = points @ points.transpose(0, 2, 1)
    out = np.full((len(own), degree), -1, np.int32)
    far = 1 - near
    for k in range(degree):
        at = alive.argmax(1)
        some = alive[b, at]
        if not some.any():
            break
        out[some, k] = ids[b, at][some]
        alive &= alpha * alpha * (1 - between[b, at]) > far
        alive[b, at] = False
    return out


def backwards(x: np.ndarray, graph: np.ndarray, own: np.ndarray, out: np.ndarray, degree: int, alpha: float) -> None:
    """Add node -> own for every edge own -> node; nodes with more than ``degree`` are pruned."""
    r, c = np.nonzero(out >= 0)
    to, source = out[r, c], own[r]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, int)
    sizes = np.diff(np.append(heads, len(to)))
    wide = int(sizes.max(initial=0))
    for i in range(0, len(heads), CHUNK):
        node = to[heads[i : i + CHUNK]]
        size = sizes[i : i + CHUNK]
        more = np.full((len(node), wide), -1, np.int32)
        place = np.repeat(np.arange(len(node)), size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        more[place, step] = source[heads[i] : heads[i] + size.sum()]
        both = np.sort(np.concatenate([graph[node], more], 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        near = np.einsum("bwd,bd->bw", x[both], x[node])
        near[both < 0] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : 3 * degree]
        both, near = np.take_along_axis(both, best, 1), np.take_along_axis(near, best, 1)
        crowded = (both >= 0).sum(1) > degree
        graph[node[~crowded]] = both[~crowded][:, :degree] if both.shape[1] >= degree else np.pad(both[~crowded], ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
        if crowded.any():
            graph[node[crowded]] = prune(x, node[crowded], both[crowded], near[crowded], degree, alpha)


def reachable(graph: np.ndarray, entries: list[int]) -> np.ndarray:
    seen = np.zeros(len(graph), bool)
    front = np.array(entries)
    while len(front):
        seen[front] = True
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~seen[front]]
    return seen


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over unit vectors x: neighbours of every node, -1 padded, and where searches begin."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    start = int(np.argmax(x @ x.mean(0)))
    flat = np.append(np.ones(x.shape[1] - 1, np.float32), np.float32(0))
    asked = degree // 2 if (x[:, -1] > 1e-3).any() else 0
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    order = np.concatenate([[np.int32(start)], order[order != start]])
    for round_, slack in enumerate((1.0, alpha)):
        i = 1 if round_ == 0 else 0
        while i < n:
            own = order[i : i + (min(i, CHUNK) if round_ == 0 else CHUNK)]
            ids, near = beam_search(x, graph, order[: min(ENTRIES, i) if round_ == 0 else ENTRIES], x[own], beam)
            if round_:
                held = graph[own]
                held = np.where((held[:, :, None] == ids[:, None, :]).any(2), -1, held)
                products = np.einsum("bwd,bd->bw", x[held], x[own])
                products[held < 0] = -np.inf
                ids, near = np.concatenate([ids, held], 1), np.concatenate([near, products], 1)
                best = np.argsort(-near, axis=1, kind="stable")
                ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
            out = prune(x, own, ids, near, degree - asked, slack)
            if asked:
                side = x[own] * flat
                side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
                ids, near = beam_search(x, graph, order[: min(ENTRIES, i) if round_ == 0 else ENTRIES], side, beam)
                more = prune(x, own, ids, near, asked, slack)
                out = np.sort(np.concatenate([out, more], 1), axis=1)
                out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
            graph[own] = out
            backwards(x, graph, own, out, degree, slack)
            i += len(own)
    entries = order[:ENTRIES].tolist()
    while not (seen := reachable(graph, entries)).all():
        entries.append(int(np.argmin(seen)))
    return graph, np.array(entries, np.int32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors with one more coordinate, in float32; the longest row gets 0 there."""
    y = rows / np.abs(rows).max()
    size = (y * y).sum(1)
    top = size.max()
    return np.concatenate([y, np.sqrt(np.maximum(top - size, 0))[:, None]], 1).astype(np.float32) / np.float32(math.sqrt(top))


def packed(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


INDEX = "shard int, dim int, ids binary, starts binary, vectors binary, graph binary, entries binary"


def build_shards(rows: DataFrame, k: int, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row for each shard and dimension of rows(shard, dim, vec_id, x)."""

    kind = "<f4" if dict(rows.dtypes)["x"] == "array<float>" else "<f8"

    def run(key: tuple, part: pa.Table) -> pa.Table:
        shard, dim = (v.as_py() for v in key)
        ids, x = part.column("vec_id").to_numpy(), matrix(part.column("x"), dim)
        nodes, of = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        of, ids = of.ravel()[order], ids[order]
        heads = np.searchsorted(of, np.arange(len(nodes)))
        first = np.arange(len(of)) - heads[of] <= k  # a result names k at most, and the query's own row may be one
        starts = np.searchsorted(of[first], np.arange(len(nodes) + 1))
        graph, entries = build_graph(unit(nodes), degree, beam, alpha)
        row = [shard, dim, packed(ids[first], "<i8"), packed(starts, "<i8"), packed(nodes, kind), packed(graph, "<i4"), packed(entries, "<i4")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    return rows.groupBy("shard", "dim").applyInArrow(run, INDEX)


def exact(nodes: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of q's rows with nodes[at], in double precision, added up from the first component on."""
    total = np.zeros(at.shape)
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            total += nodes[at, d] * q[:, d, None]
    return total


def answers(row: dict, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of a shard: (query, ids, scores), by score, ties by id."""
    dim = q.shape[1]
    ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
    nodes = np.frombuffer(row["vectors"], "<f4" if len(row["vectors"]) == 4 * dim * (len(starts) - 1) else "<f8").astype(float).reshape(-1, dim)
    graph, entries = np.frombuffer(row["graph"], "<i4").reshape(len(nodes), -1), np.frombuffer(row["entries"], "<i4")
    x = unit(nodes)
    for i in range(0, len(q), CHUNK):
        part = q[i : i + CHUNK]
        side = np.zeros((len(part), dim + 1), np.float32)
        side[:, :dim] = part / np.abs(part).max(1, keepdims=True)
        at, _ = beam_search(x, graph, entries, side, max(beam, k + 1))
        score = np.where(at >= 0, exact(nodes, at, part), -np.inf)
        order = np.lexsort((ids[starts[:-1][at]], -score), axis=1)[:, : k + 1]
        at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
        for j, own in enumerate(query_ids[i : i + CHUNK]):
            real = at[j] >= 0
            some = np.concatenate([ids[starts[n] : starts[n + 1]] for n in at[j][real]] or [np.empty(0, np.int64)])
            each = np.repeat(score[j][real], np.diff(starts)[at[j][real]])
            other = some != own
            some, each = some[other], each[other]
            best = np.lexsort((some, -each))[:k]
            yield own, some[best], each[best]


FOUND = "query_id long, shard int, found array<struct<far: double, vec_id: long>>"


def search_shards(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, shard, found) of every query in every shard.

    queries(block, dim, q): blocks of about QUERY_ROWS queries, packed in one row. A block
    and a shard meet in one group, so that a group has a bounded size.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, shard, lists = [], [], []
        for row in right.to_pylist():  # none where a shard holds no vector of that length
            for chunk in left.column("q").chunks:
                flat = chunk.flatten()
                ids = flat.field("vec_id").to_numpy(zero_copy_only=False)
                q = np.asarray(flat.field("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
                for query, some, score in answers(row, ids, q, k, beam):
                    own.append(int(query))
                    shard.append(row["shard"])
                    lists.append([{"far": -v, "vec_id": n} for v, n in zip(score.tolist(), some.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table([pa.array(own, pa.int64()), pa.array(shard, pa.int32()), pa.array(lists, kind)], names=["query_id", "shard", "found"])

    left = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "dim"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def merged(found: DataFrame, shards: int, k: int) -> DataFrame:
    """(query_id, found): the k best of all shards, merged MERGE shards at a time."""
    while True:
        found = found.groupBy("query_id", F.call_function("div", F.col("shard"), F.lit(MERGE)).cast("int").alias("shard")).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found")
        )
        shards = -(-shards // MERGE)
        if shards <= 1:
            return found.select("query_id", "found")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows that take part, each once."""
    rows = pick(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~odd & F.exists("x", lambda v: v != 0)).distinct()


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, alpha: float = ALPHA
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by ``every``."""
    is_query = F.col("vec_id") % every == 0
    n, asked = pick(vectors, "vec_id").agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // QUERY_ROWS))
    rows = usable(vectors).withColumn("dim", F.size("x"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int"))
    index = written(build_shards(dealt, k, degree, build_beam, alpha), "graphs")
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")
    queries = rows.filter(is_query).groupBy(block.alias("block"), "dim").agg(F.collect_list(F.struct("vec_id", "x")).alias("q"))  # about QUERY_ROWS
    best = merged(search_shards(index, queries, shards, blocks, k, beam), shards, k)
    out = best.select("query_id", F.posexplode("found").alias("i", "f"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("f.far")).alias("score"))
