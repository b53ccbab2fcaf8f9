"""Spatial modes of a layout of any size: block Lanczos.

The operator is the matrix of inverse distances within a radius, centred in rows and columns. It is
never formed: a step adds up the last block of basis columns over every cell's neighbours, tile by tile,
and makes the result orthogonal to all earlier columns (and to the constant one, which is the centring). A cell
keeps its basis values in one array; the driver only sees products of columns, a few hundred squared.

For nulls, the basis starts from the measurements themselves. With Q its columns, T = Q' O Q and
A = Q B, random signs S of T's eigenvectors Y give Q Y S Y' B. Whatever the number of steps, that keeps
every gene's mean and Moran's I and all covariances of genes, also the spatial ones: A' O A and A' A
stay as they are. With as many columns as cells, T's eigenvectors are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..functions.surrogates import turned_modes
from ..sources.scratch import written
from .halo import arrays, least_distance, matrix, weighted_sums
from .ranks import bucket_rank
from .vectors import total

#: Lanczos steps of the null measurements: basis columns are at most this many times the genes.
STEPS = 4
#: Directions whose squared length falls below this share of the block's are not followed.
NOISE = 1e-11
SURROGATES = "slot int, cell_id long, a array<double>"


@dataclass
class Basis:
    """rows(cell_id, q): the constant column and the orthonormal ones; t = Q'OQ and start = Q'A without the constant one."""

    rows: DataFrame
    t: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    beyond: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.eigh(self.t)


def products(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows (q, u) of f's matrices: added up by task, then by matrix row."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                got = f(matrix(b.column(0)), matrix(b.column(1)))
                sums = [x + y for x, y in zip(sums, got, strict=True)] if sums else got
        for k, m in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), k, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), arrays(m)], names=["k", "r", "a"])

    rows = df.select("q", "u").mapInArrow(part, "k int, r int, a array<double>").groupBy("k", "r").agg(total("a").alias("a")).collect()  # basis columns
    out: dict[int, dict[int, list]] = {}
    for k, r, a in rows:
        out.setdefault(k, {})[r] = a
    return [np.array([m[r] for r in sorted(m)]) for _, m in sorted(out.items())]


def grown(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(cell_id, q): the basis with f(q, u) as further columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), arrays(np.concatenate([q, f(q, matrix(b.column(2)))], 1))], names=["cell_id", "q"])

    return df.select("cell_id", "q", "u").mapInArrow(run, "cell_id long, q array<double>")


def orthogonal(state: DataFrame, grow: bool = True) -> tuple[DataFrame | None, np.ndarray, np.ndarray]:
    """state(cell_id, q, u) as (basis with new columns, h, r) such that u = q h + new r.

    Columns are projected out twice, and the new ones are made orthonormal twice, by their products.
    """
    h1, size = products(state, lambda q, u: [q.T @ u, u.T @ u])
    h2, s = products(state, lambda q, u: [q.T @ (v := u - q @ h1), v.T @ v])
    values, vectors = np.linalg.eigh(s - h2.T @ h2)
    keep = values > NOISE * max(np.abs(size).max(), 1e-300)
    root, vectors = np.sqrt(values[keep]), vectors[:, keep]
    h, r, turn = h1 + h2, root[:, None] * vectors.T, vectors / root
    if not grow or not keep.any():
        return None, h, r
    h3, s = products(state, lambda q, u: [q.T @ (v := (u - q @ h) @ turn), v.T @ v])
    low = np.linalg.cholesky(s - h3.T @ h3)
    back = np.linalg.inv(low).T
    return grown(state, lambda q, u: ((u - q @ h) @ turn - q @ h3) @ back), h + h3 @ r, low.T @ r


@dataclass
class Layout:
    """cells(cell_id, x, y) whose pairs within the radius are linked, and the least distance that counts."""

    cells: DataFrame
    radius: float
    least: float

    def times(self, rows: DataFrame, width: int) -> DataFrame:
        """(cell_id, q, u): u sums the last ``width`` basis values over a cell's neighbours, over their distances."""
        last = rows.select("cell_id", F.slice("q", -width, width).alias("v"))
        return rows.join(weighted_sums(self.cells.join(last, "cell_id"), self.radius, self.least), "cell_id").select("cell_id", "q", "u")


def layout(cells: DataFrame, radius: float) -> Layout:
    """Without any pair there is no operator, which is an error."""
    least = least_distance(cells, radius)
    if least is None:
        raise ValueError(f"no two cells within {radius}")
    return Layout(cells.select("cell_id", "x", "y"), radius, least)


def lanczos(rows: DataFrame, links: Layout, steps: int) -> Basis:
    """A basis of the blocks A, OA, ..., O^(steps - 1) A for rows(cell_id, a), the columns of a less their means.

    Ends early where nothing new comes.
    """
    n = rows.count()
    start = rows.select("cell_id", F.array(F.lit(1 / np.sqrt(n))).alias("q"), F.col("a").alias("u"))
    q, h, r = orthogonal(start)
    mean = h[0] / np.sqrt(n)
    if q is None:
        raise ValueError("all measurements are constant")
    t, first = np.zeros((len(r), len(r))), r
    for step in range(steps):
        q, width, k = written(q, "basis"), len(r), len(t)
        state = written(links.times(q, width), "product")
        more, h, r = orthogonal(state, grow=step + 1 < steps)
        t[:, k - width :] = h[1:]
        if more is None:
            break
        wide = np.zeros((k + len(r), k + len(r)))
        wide[:k, :k], wide[k:, k - width : k], q = t, r, more
        t = wide
    t = (np.tril(t) + np.tril(t).T) - np.diag(np.diag(t))
    return Basis(q, t, np.concatenate([first, np.zeros((len(t) - len(first), first.shape[1]))]), mean, r)


def hashed_start(cells: DataFrame, width: int, seed: int) -> DataFrame:
    """(cell_id, a): a start block from hashes, the same in every run."""
    return cells.select("cell_id", F.array(*(uniform(seed, "cell_id", F.lit(k)) - 0.5 for k in range(width))).alias("a"))


def leading_modes(links: Layout, count: int, width: int = 8, steps: int = 12, seed: int = 0) -> tuple[list[float], DataFrame]:
    """The eigenvalues of greatest size, largest first, and (cell_id, v) with the values of their modes."""
    basis = lanczos(hashed_start(links.cells, width, seed), links, steps)
    values, vectors = basis.pairs()
    at = np.argsort(-np.abs(values), kind="stable")[:count]
    own = np.concatenate([np.zeros((1, len(at))), vectors[:, at]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), arrays(matrix(b.column(1)) @ own)], names=["cell_id", "v"])

    return values[at].tolist(), written(basis.rows.select("cell_id", "q").mapInArrow(run, "cell_id long, v array<double>"), "modes")


def mode_residuals(links: Layout, modes: DataFrame, values: list[float]) -> DataFrame:
    """(mode, eigenvalue, residual, length): the length of O v - value v, and of v, for modes(cell_id, v)."""
    k = len(values)
    held = links.times(modes.withColumnRenamed("v", "q"), k)
    at = held.select("cell_id", F.posexplode(F.arrays_zip("q", "u")).alias("mode", "z")).select("mode", F.col("z.q").alias("v"), F.col("z.u").alias("u"))
    lam = F.array(*(F.lit(float(x)) for x in values))[F.col("mode")]
    own = at.select("mode", lam.alias("eigenvalue"), "v", (F.col("u") - lam * F.col("v")).alias("e"))
    n = F.count("*")
    return own.groupBy("mode", "eigenvalue").agg(F.sqrt(F.var_pop("e") * n).alias("residual"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))


def mode_surrogates(
    cells: DataFrame, expr: DataFrame, n: int, seed: int, radius: float, truncate: float = 0.0, calibration: float | None = None, ranks: bool = False, steps: int = STEPS
) -> DataFrame:
    """Nulls from random signs of the layout's spatial modes; (slot, cell_id, a), slot 0 the truth.

    One sign a mode is shared by all genes. truncate > 0: only modes of a longer scale,
    calibration / sqrt(|eigenvalue|), take signs; calibration: the length that eigenvalue 1
    stands for, truncate itself, or radius where that is 0. ranks: deal the true values of
    the whole layout in the surrogate's order.
    """
    from .surrogates import rows_of

    rows = rows_of(cells, expr)
    basis = lanczos(rows, layout(cells, radius), steps)
    values, vectors = basis.pairs()
    turn = turned_modes(values, truncate, calibration or truncate or radius)
    parts = vectors.T @ basis.start
    signs = [np.where(turn, np.random.default_rng([seed, k]).choice([-1.0, 1.0], len(values)), 1.0) for k in range(1, n + 1)]
    each = [np.concatenate([np.zeros((1, parts.shape[1])), vectors @ (s[:, None] * parts)]) for s in signs]
    mean = basis.mean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(1))
                for k, m in enumerate(each, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), k, np.int32)), b.column(0), arrays(mean + q @ m)], names=["slot", "cell_id", "a"])

    nulls = basis.rows.select("cell_id", "q").mapInArrow(run, SURROGATES)
    truth = rows.select(F.lit(0).alias("slot"), "cell_id", "a")
    return truth.unionByName(dealt_by_rank(truth, nulls) if ranks else nulls)


def dealt_by_rank(truth: DataFrame, nulls: DataFrame, per_task: int = 200_000) -> DataFrame:
    """(slot, cell_id, a): each gene's true values in the order of every null's, over all cells. The truth is ranked once.

    A gene's cells are cut at its true values' quantiles, so buckets grow in number with the cells alone.
    """
    k = -(-truth.count() // per_task)
    flat = truth.select("slot", "cell_id", F.posexplode("a").alias("g", "value"))
    bounds = flat.groupBy("g").agg(F.percentile_approx("value", [i / k for i in range(1, k)], 10 * k).alias("bounds")) if k > 1 else None

    def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
        flat = df.select("slot", "cell_id", F.posexplode("a").alias("g", "value"))
        if bounds is None:
            return bucket_rank(flat, keys, None, ["value", "cell_id"])
        cut = flat.join(F.broadcast(bounds), "g")  # one row a gene
        return bucket_rank(cut, keys, F.size(F.filter("bounds", lambda b: b <= F.col("value"))), ["value", "cell_id"]).drop("bounds")

    own = ranked(truth, ["g"]).select("g", "_r", "value")
    places = ranked(written(nulls, "nulls"), ["slot", "g"]).select("slot", "cell_id", "g", "_r")
    dealt = places.join(own, ["g", "_r"])
    return dealt.groupBy("slot", "cell_id").agg(F.sort_array(F.collect_list(F.struct("g", "value"))).alias("r")).select("slot", "cell_id", F.col("r.value").alias("a"))
