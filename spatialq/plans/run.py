"""A configured run: load, select, transform, rewrite space, test, and one result row."""

from __future__ import annotations

import itertools
import json
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, parse
from ..functions.networks import Plan
from ..operators import comparisons as C
from ..operators import decoders as D
from ..operators import expr as E
from ..operators import genes as G
from ..operators import modes as MD
from ..operators import moran as MO
from ..operators import nulls as N
from ..operators import rows as R
from ..operators import spatial as SP
from ..operators import surrogates as SG
from ..operators import trained as T
from ..sources import results, synthetic
from ..sources.scratch import written


def load(spark: SparkSession, c: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(cells, expr) after row and gene selection, in the order filters, panel, variable genes, support."""
    d = c.data
    if d["source"] == "synthetic":
        side = max(2, round(d["n_cells"] ** 0.5))
        cells = synthetic.lattice(spark, side, d["shape"])
        expr = synthetic.manifold(cells, d["mode"], d["n_genes"], d["sigma"], d["seed"])
    else:
        cells, expr = results.read_cells(spark, d["table"])
        if d["layer"]:
            expr = expr.filter(F.col("layer") == d["layer"])
    if d["obs_filters"]:
        cells = R.filter_equal(cells, d["obs_filters"])
    if d["obs_numeric_filters"]:
        cells = R.filter_range(cells, d["obs_numeric_filters"])
    if d["obs_drop_na"]:
        cells = R.drop_missing(cells, d["obs_drop_na"])
    if d["obs_indices"]:
        cells = R.subset_by_index(cells, spark.read.parquet(d["obs_indices"]))
    if d["max_cells"]:
        cells = R.subsample(cells, d["max_cells"], d["seed"])
    if d["cell_type"] and d["min_cells_per_celltype"] > 1:
        cells = R.min_group(cells, "cell_type", d["min_cells_per_celltype"]).drop("code")
    cells = R.some_rows(cells)
    expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    names = expr.select("gene").distinct()
    if d["exclude_gene_patterns"]:
        expr = G.panel(expr, G.exclude_genes(names, d["exclude_gene_patterns"]))
    if d["gene_list"]:
        expr = G.panel(expr, spark.createDataFrame([(g,) for g in d["gene_list"]], "gene string"))
    if d["top_var_genes"]:
        expr = G.panel(expr, G.highly_variable(expr, cells.count(), d["top_var_genes"]).select("gene"))
    return cells, R.some_rows(G.min_cells(expr, d["min_cells_per_gene"]))


def transform(c: RunConfig, cells: DataFrame, expr: DataFrame) -> DataFrame:
    expr = E.densify(cells, expr)
    if c.data["normalize_total"]:
        expr = E.cpm(expr)
    if c.data["log1p"]:
        expr = E.log1p(expr)
    w = c.data["covariate_whitening"]
    if w and w["method"] == "freedman-lane":
        z = R.zscore_columns(cells.select("cell_id", F.col(w["column"]).cast("double").alias("z")), ["z"])
        rows = expr.join(z, "cell_id")
        fit = D.linear_fit(D.linear_sums(rows, ["gene"])).select("gene", "slope", "intercept")
        expr = rows.join(F.broadcast(fit), "gene").select("cell_id", "gene", (F.col("value") - F.col("slope") * F.col("z") - F.col("intercept")).alias("value"))
    return expr


def reshape(c: RunConfig, cells: DataFrame) -> DataFrame:
    """Outliers out, regions split, coordinates standardised, crop: in that order."""
    d, unit = c.data, c.test["coordinate_um_per_unit"] or 1.0
    if d["spatial_denoise_radius_um"]:
        cells = SP.denoise(cells, d["spatial_denoise_radius_um"] / unit)
    split = d["spatial_region_split"]
    if split is True:
        eps = d["spatial_region_split_eps"] or SP.auto_eps(cells, 0.9, d["spatial_region_split_eps_mult"]).first()["eps"]
        found = SP.relabel_by_size(SP.dbscan(cells, eps, d["spatial_region_split_min_samples"]), d["spatial_region_split_min_cells"])
        cells = cells.join(found, "cell_id").withColumn("cell_type", F.concat("cell_type", F.lit("_r"), F.col("region").cast("string"))).drop("region")
    elif split:
        found = SP.kmeans(cells, int(split), d["seed"])
        cells = cells.join(found, "cell_id").withColumn("cell_type", F.concat("cell_type", F.lit("_r"), F.col("cluster").cast("string"))).drop("cluster")
    if d["standardize_coordinates"] and c.test["method"] != "block_permutation":
        cells = R.zscore_columns(cells, ["x", "y"])
    if d["spatial_crop"]:
        cells = R.filter_range(cells, d["spatial_crop"])
    return R.some_rows(cells)


def plan_of(c: RunConfig) -> Plan:
    t = c.test
    metric = "poisson" if t["metric"] == "nll_poisson_mse" else "gaussian"
    return Plan(
        t["decoder"], metric=metric, epochs=t["epochs"], rate=t["lr"], patience=t["patience"] or t["epochs"], seed=t["seed"], batch=t["sgd_batch_size"] or 0,
        cosine=t["sgd_cosine_lr_decay"], least_rate=t["sgd_cosine_eta_min"], warm=t["gaussian_pretrain_epochs"], freeze=t["gaussian_pretrain_freeze_encoder"],
    )


def spot_radius(distance: float, shape: str) -> float:
    """The tile radius of bins whose centres are so far apart: half of it for squares, over the root of 3 for hexagons."""
    return distance / math.sqrt(3) if shape == "hexagon" else distance / 2


def targets(c: RunConfig, cells: DataFrame, expr: DataFrame) -> DataFrame:
    """What the decoders fit: counts for Poisson losses, else standardised values, for types together less their types' means."""
    if c.test["metric"] == "nll_poisson_mse":
        return expr
    if c.data["standardize_expression"]:
        expr = E.zscore(expr)
    return E.residuals(expr, cells).drop("cell_type") if c.data["cell_type"] == "together" else expr


def losses(c: RunConfig, cells: DataFrame, expr: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(part, slot, stat) of the configured test, slot 0 the truth; part is a delta, a fraction, a fold or null (all folds). And (fraction, correlation) where there is one."""
    t, method = c.test, c.test["method"]
    unit = t["coordinate_um_per_unit"] or 1.0
    plan, n, seed = plan_of(c), t["n_perms"], t["seed"]
    if method == "binning":
        b = written(SP.bin_cells(cells, expr, spot_radius(t["bin_spot_distance_um"] / unit, t["bin_shape"]), t["bin_shape"]), "spots")
        expr = b.select(F.col("bin").alias("cell_id"), "gene", "value")
        cells = b.select(F.col("bin").alias("cell_id"), "x", "y").distinct().withColumn("cell_type", F.lit("all"))
    e = targets(c, cells, expr)
    together = c.data["cell_type"] == "together" and method != "binning"
    fit = {"reruns": t["n_reruns"], "by_type": together}
    metric, alike = t["metric"], None
    if method in ("joint_truncated_msr", "joint_truncated_rank_msr"):
        radius, truncate = t["msr_neighbor_radius_um"] / unit, (t["msr_truncate_um"] or 0.0) / unit
        nulls = MD.mode_surrogates(cells, e, n, seed, radius, truncate, ranks="rank" in method)
        stats = T.statistics(T.fit_nulls(cells, SG.standardised(nulls), plan, t["n_reruns"]), metric)
    elif method == "fourier_spectral_randomization":
        stats = T.statistics(T.fit_nulls(cells, SG.standardised(SG.phase_surrogates(cells, e, n, seed)), plan, t["n_reruns"]), metric)
    elif method == "cross_validation":
        masks = T.fold_masks(N.kfold(cells, t["n_folds"], seed))
        fitted = T.fit_slots(N.permute(cells, n, seed, ["x", "y"], ("cell_type",) if together else ()), cells, e, plan, masks=masks, **fit)
        whole = T.by_folds(fitted, metric).withColumn("part", F.lit(None).cast("double"))
        stats = whole.unionByName(T.statistics(fitted, metric).select("slot", "stat", F.col("variant").cast("double").alias("part")))
    elif method == "perturbation_test":
        stats = C.perturbation_stats(cells, e, plan, t["delta"], n, seed, metric, **fit).withColumnRenamed("delta", "part")
    elif method == "comparison_perturbation_test":
        stats = C.compared_perturbation_stats(cells, e, plan, t["delta"], n, t["n_nulls"], seed, metric, **fit).withColumnRenamed("delta", "part")
    elif method == "subsampling_test":
        stats = C.subsampling_stats(cells, e, plan, t["subset_fractions"], n, seed, metric, **fit).withColumnRenamed("fraction", "part")
    elif method == "comparison_subsampling_test":
        stats, alike = C.compared_subsampling_stats(cells, e, plan, t["subset_fractions"], n, t["n_nulls"], seed, metric, **fit)
        stats = stats.withColumnRenamed("fraction", "part")
    else:
        if method == "block_permutation":
            slots = N.block_permutation(cells, n, seed, t["block_radius"] / unit, t["block_shape"], t["block_jitter"], ("cell_type",) if together else ())
        else:
            slots = N.permute(cells, n, seed, ["x", "y"], ("cell_type",) if together else ())
        w = c.data["covariate_whitening"]
        if w and w["method"] == "loss-difference" and method != "binning":
            fit["covariate"] = R.zscore_columns(cells.select("cell_id", F.col(w["column"]).cast("double").alias("z")), ["z"])
        stats = T.statistics(T.fit_slots(slots, cells, e, plan, **fit), metric)
    if "part" not in stats.columns:
        stats = stats.withColumn("part", F.lit(None).cast("double"))
    return stats.select("part", "slot", "stat"), alike


def recursive(c: RunConfig, cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Genes of each gradient, see comparisons.recursive_svg."""
    t = c.test
    return C.recursive_svg(cells, targets(c, cells, expr), plan_of(c), t["n_perms"], t["seed"], t["alpha"], t["max_gradients"], t["metric"], reruns=t["n_reruns"])


def run(spark: SparkSession, c: RunConfig) -> DataFrame:
    """One result row, or one a cell type with ``cell_type: separate``; also p of Moran's I if asked for."""
    began = time.time()
    cells, expr = load(spark, c)
    cells = reshape(c, cells)
    expr = expr.join(cells.select("cell_id"), "cell_id", "left_semi")
    split = c.data["cell_type"] == "separate" or bool(c.data["spatial_region_split"])
    kinds = [r[0] for r in cells.groupBy("cell_type").count().orderBy(F.desc("count"), "cell_type").collect()] if split else [None]
    out = []
    for kind in kinds:
        own = cells if kind is None else cells.filter(F.col("cell_type") == kind)
        e = transform(c, own, expr if kind is None else expr.join(own.select("cell_id"), "cell_id", "left_semi"))
        extra = {"cell_type": kind} if kind else {}
        if c.test["recursive"]:
            found = recursive(c, own, e).orderBy("gradient", "p_value", "gene").collect()  # one row a gene
            extra["svg"] = json.dumps([r.asDict() for r in found])
        stats, alike = losses(c, own, e)
        stats = stats.orderBy("part", "slot").collect()  # one row a layout
        higher = "corr" in c.test["metric"]
        parts = {}
        for part in dict.fromkeys(r["part"] for r in stats):
            truth = next(r["stat"] for r in stats if r["part"] == part and r["slot"] == 0)
            nulls = [r["stat"] for r in stats if r["part"] == part and r["slot"]]
            good = sum(x >= truth if higher else x <= truth for x in nulls)
            parts[part] = {"p_value": (good + 1) / (len(nulls) + 1), "stat_true": truth, "nulls": nulls}
        if alike is not None:
            for r in alike.collect():
                parts[r["fraction"]]["correlation"] = r["correlation"]
        first = {"perturbation_test": "delta", "comparison_perturbation_test": "delta", "subsampling_test": "subset_fractions", "comparison_subsampling_test": "subset_fractions"}.get(c.test["method"])
        main = parts[float(c.test[first][0]) if first else None]
        if len(parts) > 1 or first:  # deltas, fractions or folds
            extra["parts"] = json.dumps({str(k): v for k, v in parts.items()}, sort_keys=True)
        if c.test["moran"]:
            radius = c.test["moran_neighbor_radius_um"] / (c.test["coordinate_um_per_unit"] or 1.0)
            moran = MO.morans_i(own, e, radius).agg(F.avg("moran")).first()[0]
            if moran is not None:  # no pairs within the radius: no statistic
                extra["moran_mean"] = str(moran)
        n, g = own.count(), e.select("gene").distinct().count()
        out.append((c.output["run_name"], c.test["method"], c.test["metric"], main["p_value"], main["stat_true"], main["nulls"], time.time() - began, n, g, c.as_json(), extra))
    return spark.createDataFrame(out, results.RESULT)


def sweep(spark: SparkSession, raw: dict, grid: dict[str, list]) -> DataFrame:
    """One result row for each combination of grid's values; keys are ``section.key``, and run names tell the values."""
    out = None
    for values in itertools.product(*grid.values()):
        named = dict(zip(grid, values, strict=True))
        extra: dict = {"output": {"run_name": "_".join(f"{k.partition('.')[2]}-{v}" for k, v in named.items())}}
        for k, v in named.items():
            section, _, key = k.partition(".")
            extra.setdefault(section, {})[key] = v
        row = run(spark, parse(raw, extra))
        out = row if out is None else out.unionByName(row)
    return out
