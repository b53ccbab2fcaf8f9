"""Trained tests: results that SQL cannot express, checked by planted signals, brute force and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.networks import Plan
from ..operators import comparisons as C
from ..operators import expr as E
from ..operators import lowrank
from ..operators import modes as MD
from ..operators import nulls as N
from ..operators import spatial as SP
from ..operators import surrogates as SG
from ..operators import trained as T
from ..sources.scratch import written
from .registry import query

PLAN = Plan(epochs=12, rate=0.05)


def inputs(spark, d):
    return B.dense_cells(spark, d), E.zscore(B.dense_expr(spark, d))


@query()
def parallel_permutation(spark, d):
    """Trained depth axis against coordinate permutations."""
    cells, e = inputs(spark, d)
    return T.test(T.fit_slots(N.coordinate_permutation(cells, 9, 3), cells, e, PLAN, reruns=2))


@query()
def parallel_permutation_by_type(spark, d):
    """One encoder, a decoder for each cell type, on residuals from the types' means."""
    cells, e = inputs(spark, d)
    slots = N.permute(cells, 5, 3, ["x", "y"], ("cell_type",))
    return T.test(T.fit_slots(slots, cells, E.residuals(e, cells), PLAN, by_type=True))


@query()
def block_permutation(spark, d):
    cells, e = inputs(spark, d)
    return T.test(T.fit_slots(N.block_permutation(cells, 9, 5, 0.05), cells, e, PLAN))


@query()
def midline_encoder(spark, d):
    """As the permutation test, with a depth that is the distance from a learned line."""
    cells, e = inputs(spark, d)
    return T.test(T.fit_slots(N.coordinate_permutation(cells, 9, 3), cells, e, Plan(encoder="midline", epochs=12, rate=0.05)))


@query()
def loss_difference(spark, d):
    """A covariate joins the decoder's input and is never permuted."""
    from ..operators.rows import zscore_columns

    cells, e = inputs(spark, d)
    cov = zscore_columns(cells.select("cell_id", F.col("y").alias("z")), ["z"])
    return T.test(T.fit_slots(N.coordinate_permutation(cells, 9, 3), cells, e, PLAN, covariate=cov))


@query()
def joint_truncated_msr(spark, d):
    """Nulls from random signs of the long-range spatial modes."""
    cells, e = inputs(spark, d)
    nulls = MD.mode_surrogates(cells, e, 5, 3, SP.density_radius(cells, 12.0), 0.1, calibration=1.0)
    return T.test(T.fit_nulls(cells, SG.standardised(nulls), PLAN))


@query()
def joint_truncated_rank_msr(spark, d):
    """As above, with the true values dealt in the surrogates' order."""
    cells, e = inputs(spark, d)
    nulls = MD.mode_surrogates(cells, e, 5, 3, SP.density_radius(cells, 12.0), 0.1, calibration=1.0, ranks=True)
    return T.test(T.fit_nulls(cells, SG.standardised(nulls), PLAN))


@query()
def fourier_spectral_randomization(spark, d):
    """Random phases on a full grid: mean discounts and taxes of line items by quantity and line number."""
    g = B.read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    g = g.agg(*(F.avg(c).alias(c) for c in ("l_discount", "l_tax", "l_extendedprice"))).withColumn("cell_id", (F.col("x") * 10 + F.col("y")).cast("long"))
    cells = g.select("cell_id", "x", "y")
    e = E.zscore(g.select("cell_id", F.explode(F.create_map(*(z for c in ("l_discount", "l_tax", "l_extendedprice") for z in (F.lit(c), F.col(c))))).alias("gene", "value")))
    return T.test(T.fit_nulls(cells, SG.standardised(SG.phase_surrogates(cells, e, 9, 3)), PLAN))


@query()
def cross_validation(spark, d):
    """Held-out losses by fold, weighted by fold size, against permuted layouts."""
    cells, e = inputs(spark, d)
    masks = T.fold_masks(N.kfold(cells, 3, 11))
    t = T.fit_slots(N.coordinate_permutation(cells, 5, 3), cells, e, PLAN, masks=masks)
    return T.permutation_p(T.by_folds(t, "mse"), [])


@query()
def perturbation_test(spark, d):
    """The true layout's loss against jittered layouts, by size of the jitter."""
    cells, e = inputs(spark, d)
    return C.perturbation(cells, e, PLAN, [0.05, 0.2], 4, 4, "nll_gaussian_mse")


@query()
def comparison_perturbation_test(spark, d):
    """How alike the depths of true and jittered layouts are, against permuted measurements."""
    cells, e = inputs(spark, d)
    return C.compared_perturbation(cells, e, PLAN, [0.05, 0.2], 2, 4, 4, "spearman_corr_mean")


@query()
def subsampling_test(spark, d):
    """Losses of models fitted on subsets of the cells, over their fractions."""
    cells, e = inputs(spark, d)
    return C.subsampling(cells, e, PLAN, [0.5, 0.75], 2, 8, "nll_gaussian_mse")


@query()
def comparison_subsampling_test(spark, d):
    """Mean losses on subsets against permuted measurements, with the depths' rank correlation."""
    cells, e = inputs(spark, d)
    return C.compared_subsampling(cells, e, PLAN, [0.5, 0.75], 2, 4, 8, "nll_gaussian_mse")


@query()
def binning_test(spark, d):
    """Counts summed into square pseudo-spots, then the permutation test on log counts."""
    spots = SP.bin_cells(B.count_cells(spark, d), lambda binned: B.count_rows(spark, d, binned), 500.0)
    b = written(spots.select(F.col("bin").alias("cell_id"), "x", "y", "gene", "value"), "spots")
    cells = b.select("cell_id", "x", "y").distinct().withColumn("cell_type", F.lit("all"))
    e = E.log1p(E.cpm(E.densify(cells, b.select("cell_id", "gene", "value"))))
    return T.test(T.fit_slots(N.coordinate_permutation(cells, 9, 3), cells, E.zscore(e), PLAN))


@query()
def recursive_svg(spark, d):
    """Gradients one after another on measurements with a planted axis: two of the genes follow x."""
    e = E.zscore(B.dense_expr(spark, d, with_x=True))
    strong = F.when(F.col("gene").isin("g02", "g03"), F.col("value") + 40 * F.col("x")).otherwise(F.col("value"))
    planted = e.select("cell_id", "gene", strong.alias("value"))
    return C.recursive_svg(B.dense_cells(spark, d), E.zscore(planted), Plan(epochs=25, rate=0.05), 9, 3, alpha=0.2, max_gradients=2)


@query()
def low_rank_poisson(spark, d):
    """Norms of Poisson factors of the counts, strongest first."""
    cells = B.count_cells(spark, d)
    return lowrank.factor_norms(lowrank.fit(E.densify(cells, B.count_expr(spark, d)), 4, rounds=4))


@query()
def synthetic(spark, d):
    """Summary of simulated layouts and measurements."""
    from ..sources.synthetic import lattice, manifold

    cells = lattice(spark, 30)
    e = manifold(cells, "fourier", 5, 0.5, 2)
    return e.groupBy("gene").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@query()
def minibatch_history(spark, d):
    """p-values by epoch of a permutation test trained in steps of 256 cells with a falling rate."""
    from ..operators.studies import p_trajectory

    cells, e = inputs(spark, d)
    plan = Plan(epochs=6, rate=0.05, batch=256, cosine=True)
    trained = T.fit_slots(N.coordinate_permutation(cells, 9, 3), cells, e, plan, reruns=2)
    return p_trajectory(trained.trajectory().withColumn("condition", F.lit("all")), ["condition"])
