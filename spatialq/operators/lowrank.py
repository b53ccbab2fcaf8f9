"""Low-rank Poisson factors of counts by alternating weighted least squares, gene by gene and cell by cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

LIMIT = 15.0


@dataclass(frozen=True)
class Factors:
    """left(cell_id, l): cell factors; genes: name -> (intercept, loadings); log sizes are offsets."""

    left: DataFrame
    genes: tuple[str, ...]
    base: np.ndarray
    right: np.ndarray


def newton(y: np.ndarray, offset: np.ndarray, design: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """One damped Newton step of a Poisson regression of each row of y on design, with log offsets."""
    eta = np.clip(offset + start @ design.T, -LIMIT, LIMIT)
    mu = np.exp(eta)
    grad = (y - mu) @ design - ridge * start
    hess = np.einsum("ng,gi,gj->nij", mu, design, design) + ridge * np.eye(design.shape[1])
    step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
    return start + step / np.maximum(1.0, np.abs(step).max(axis=1, keepdims=True))


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def leading_directions(rows: DataFrame, base: np.ndarray, rank: int, seed: int, passes: int = 4, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, genes x rank directions) of the counts' Pearson residuals, largest first.

    Randomised subspace iteration on the genes' side: a pass multiplies a few random
    directions, ``extra`` more than asked for, by the residuals and their transpose, cell by
    cell, and adds up genes x directions numbers; the driver makes them orthonormal. Sums do
    not depend on the order of cells.
    """
    spark = rows.sparkSession
    width = min(len(base), rank + extra)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(base), width)))[0]
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((base, v))

        def products(batches):
            b, d = shared.value
            total = np.zeros(d.shape)
            for batch in batches:
                mu = np.exp(np.clip(batch.column(1).to_numpy()[:, None] + b, -LIMIT, LIMIT))
                z = (matrix(batch.column(0)) - mu) / np.sqrt(mu)
                total += z.T @ (z @ d)
            g, i = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], names=["gene", "i", "x"])

        got = rows.select("y", "size").mapInArrow(products, "gene long, i long, x double").groupBy("gene", "i").agg(F.sum("x").alias("x")).toArrow()
        image = np.zeros(v.shape)
        image[got.column("gene").to_numpy(), got.column("i").to_numpy()] = got.column("x").to_numpy()
        inner = v.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz = image @ turn[:, ::-1]
        v = np.linalg.qr(ritz)[0]
        # a direction's sign is that of its largest entry
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(width)])
    return np.sqrt(np.maximum(values[::-1], 0))[:rank], v[:, :rank]


def fit(expr: DataFrame, rank: int, rounds: int = 25, seed: int = 0, ridge: float = 1.0, patience: int = 2, tolerance: float = 1e-4) -> Factors:
    """Factors of dense counts expr(cell_id, gene, value): log mean = log size + intercept + l . r.

    Loadings start along the leading singular directions of the residuals. Rounds end once the
    deviance has fallen by less than the tolerance (a share of it) ``patience`` times in a row.

    A round updates every cell's factors from its own row, given the genes' (a matrix
    genes x rank in every task), then the genes' from sums over all cells: gradients and
    second moments, rank x rank numbers a gene, added up where the cells are.
    """
    spark = expr.sparkSession
    rows = expr.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("v"), F.sum("value").alias("total"))
    rows = written(rows.select("cell_id", F.col("v.value").alias("y"), F.log(F.greatest("total", F.lit(1.0))).alias("size")), "counts")
    sums = {r["gene"]: r["s"] for r in expr.groupBy("gene").agg(F.sum("value").alias("s")).collect()}  # one row a gene
    genes = tuple(sorted(sums))
    whole = rows.agg(F.sum(F.exp("size"))).first()[0] or 1.0
    base = np.log(np.maximum([sums[g] for g in genes], 0.5)) - np.log(whole)
    values, directions = leading_directions(rows, base, rank, seed)
    right = np.zeros((len(genes), rank))
    right[:, : directions.shape[1]] = 0.5 * np.sqrt(len(genes)) * directions * (values > 0)
    last, calm = math.inf, 0
    state = rows.withColumn("l", F.array_repeat(F.lit(0.0), rank))
    schema = f"cell_id long, y array<double>, size double, l array<double>"

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((base, right))

        def cells_step(batches):
            b, r = shared.value
            for batch in batches:
                y, size, left = matrix(batch.column(1)), batch.column(2).to_numpy(), matrix(batch.column(3))
                for _ in range(3):
                    left = newton(y, size[:, None] + b, r, left, ridge)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(left), pa.list_(pa.float64()))], names=["cell_id", "y", "size", "l"])

        state = written(state.mapInArrow(cells_step, schema), "factors")
        for _ in range(2):
            now = spark.sparkContext.broadcast((base, right))

            def gene_sums(batches):
                b, r = now.value
                k = r.shape[1] + 1
                total, spent = np.zeros((len(b), k * (k + 1))), 0.0
                for batch in batches:
                    y, size = matrix(batch.column(1)), batch.column(2).to_numpy()
                    design = np.concatenate([np.ones((len(y), 1)), matrix(batch.column(3))], 1)
                    mu = np.exp(np.clip(size[:, None] + b + design[:, 1:] @ r.T, -LIMIT, LIMIT))
                    spent += 2 * float(np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0) - (y - mu)))
                    total[:, :k] += (y - mu).T @ design
                    total[:, k:] += np.einsum("ng,ni,nj->gij", mu, design, design).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(b)), total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), len(b))), pa.array(total.ravel())], names=["gene", "i", "x"])
                yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([0]), pa.array([spent])], names=["gene", "i", "x"])  # the deviance

            got = state.mapInArrow(gene_sums, "gene long, i long, x double").groupBy("gene", "i").agg(F.sum("x").alias("x")).toArrow()
            k = rank + 1
            total = np.zeros((len(genes) + 1, k * (k + 1)))
            total[got.column("gene").to_numpy(), got.column("i").to_numpy()] = got.column("x").to_numpy()
            total, now_spent = total[:-1], total[-1, 0]
            pull = np.concatenate([np.zeros((len(genes), 1)), ridge * right], 1)
            shrink = np.diag([1e-6] + [ridge] * rank)
            step = np.linalg.solve(total[:, k:].reshape(-1, k, k) + shrink, (total[:, :k] - pull)[:, :, None])[:, :, 0]
            step /= np.maximum(1.0, np.abs(step).max(axis=1, keepdims=True))
            base, right = base + step[:, 0], right + step[:, 1:]
        calm = calm + 1 if last - now_spent <= tolerance * abs(now_spent) else 0
        last = now_spent
        if calm >= patience:
            break
    return Factors(state.select("cell_id", "l", "y", "size"), genes, base, right)


def fit_by_type(cells: DataFrame, expr: DataFrame, rank: int, seed: int = 0, **how) -> dict[object, Factors]:
    """Factors of each cell type (a few) by itself; the k-th type, by name, takes seed + k."""
    kinds = sorted(r[0] for r in cells.select("cell_type").distinct().collect() if r[0] is not None)
    own = lambda kind: expr.join(cells.filter(F.col("cell_type") == kind).select("cell_id"), "cell_id", "left_semi")
    return {kind: fit(own(kind), rank, seed=seed + k, **how) for k, kind in enumerate(kinds)}


def factor_norms(f: Factors) -> DataFrame:
    """(factor, norm): each factor's norm over cells times that over genes, strongest first."""
    k = f.right.shape[1]
    left = f.left.agg(*(F.sqrt(F.sum(F.get("l", F.lit(i)) * F.get("l", F.lit(i)))).alias(f"n{i}") for i in range(k))).first()
    norms = sorted((float(left[i] * np.linalg.norm(f.right[:, i])) for i in range(k)), reverse=True)
    return f.left.sparkSession.createDataFrame(list(enumerate(norms)), "factor long, norm double")


def deviance(f: Factors) -> float:
    """Poisson deviance of the counts under the factors."""
    base, right = f.base, f.right

    def run(batches):
        for batch in batches:
            left, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (batch.column(1), batch.column(2)))
            mu = np.exp(np.clip(batch.column(3).to_numpy()[:, None] + base + left @ right.T, -LIMIT, LIMIT))
            yield pa.RecordBatch.from_arrays([pa.array([2 * float(np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0) - (y - mu)))])], names=["d"])

    return f.left.mapInArrow(run, "d double").agg(F.sum("d")).first()[0]
