"""Tests built of several trained layouts: perturbed, subsampled, compared with permuted measurements, recursive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.networks import Plan
from ..sources.scratch import written
from . import decoders as D
from . import nulls as N
from . import trained as T
from .metrics import permutation_p
from .ranks import bh_qvalues
from .vectors import gene_order


def perturbed(cells: DataFrame, deltas: list[float], n: int, seed: int) -> DataFrame:
    """(slot, cell_id, x, y): the truth, then n jittered layouts for each delta in turn."""
    out = cells.select(F.lit(0).alias("slot"), "cell_id", "x", "y")
    for i, delta in enumerate(deltas):
        own = N.perturb(cells, n, seed + i, delta).filter("slot > 0")
        out = out.unionByName(own.withColumn("slot", F.col("slot") + i * n))
    return out


def delta_of(slot: str, deltas: list[float], n: int):
    return F.get(F.array(*(F.lit(float(x)) for x in deltas)), F.floor((F.col(slot) - 1) / n).cast("int"))


def perturbation_stats(cells: DataFrame, expr: DataFrame, plan: Plan, deltas: list[float], n: int, seed: int, metric: str, **fit) -> DataFrame:
    """(delta, slot, stat): the loss of the true layout, slot 0, and of the jittered ones of each delta."""
    stats = T.statistics(T.fit_slots(perturbed(cells, deltas, n, seed), cells, expr, plan, **fit), metric).select("slot", "stat")
    nulls = stats.filter("slot > 0").select(delta_of("slot", deltas, n).alias("delta"), "slot", "stat")
    return nulls.unionByName(stats.filter("slot = 0").select(F.explode(F.array(*(F.lit(float(x)) for x in deltas))).alias("delta"), "slot", "stat"))


def perturbation(*args, **fit) -> DataFrame:
    """(delta, stat_true, p_value, n_perms): the true layout's loss against jittered ones, for each delta."""
    return permutation_p(perturbation_stats(*args, **fit), ["delta"])


def with_permuted_rows(layouts: DataFrame, n: int, n_nulls: int, seed: int) -> DataFrame:
    """Layouts 0..n, then the same for each null data set in turn, with places dealt anew among the cells.

    Dealing the places of all layouts at once is dealing the measurements' rows the other
    way round, and copies no measurement.
    """
    places = layouts.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("slot", "x", "y"))).alias("p"))
    dealt = N.permute(places, n_nulls, seed, ["p"]).select(F.col("slot").alias("k"), "cell_id", F.explode("p").alias("p"))
    return dealt.select((F.col("k") * (n + 1) + F.col("p.slot")).cast("int").alias("slot"), "cell_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def compared_perturbation_stats(cells: DataFrame, expr: DataFrame, plan: Plan, deltas: list[float], n: int, n_nulls: int, seed: int, metric: str, **fit) -> DataFrame:
    """(delta, slot, stat): mean likeness of the depths of true and jittered layouts.

    Slot 0 has the true measurements; the others have theirs permuted among the cells.
    """
    m = n * len(deltas)
    slots = with_permuted_rows(perturbed(cells, deltas, n, seed), m, n_nulls, seed + 100_000)
    depths = T.fit_slots(slots, cells, expr, plan, **fit).depths().withColumn("k", F.floor(F.col("slot") / (m + 1))).withColumn("j", F.col("slot") % (m + 1))
    base = depths.filter("j = 0").select("k", "cell_id", F.col("depth").alias("base"))
    scores = T.similarity(depths.filter("j > 0").join(base, ["k", "cell_id"]), ["k", "j"], "base", metric)
    return scores.groupBy(delta_of("j", deltas, n).alias("delta"), F.col("k").cast("int").alias("slot")).agg(F.avg("score").alias("stat"))


def compared_perturbation(*args, **fit) -> DataFrame:
    """(delta, stat_true, p_value, n_perms) of compared_perturbation_stats; the last argument is the likeness."""
    return permutation_p(compared_perturbation_stats(*args, **fit), ["delta"], higher_is_better="corr" in args[-1])


def subsampling(cells: DataFrame, expr: DataFrame, plan: Plan, fractions: list[float], draws: int, seed: int, metric: str, **fit) -> DataFrame:
    """(variant, fraction, loss): losses of models on subsets over their fraction; variant 0 has all cells."""
    masks = T.draw_masks(N.subset_masks(cells, fractions, draws, seed), fractions, draws)
    stats = T.statistics(T.fit_slots(cells.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), cells, expr, plan, masks=masks, **fit), metric)
    fraction = F.when(F.col("variant") == 0, 1.0).otherwise(delta_of("variant", fractions, draws))
    return stats.select("variant", fraction.alias("fraction"), (F.col("stat") / fraction).alias("loss"))


def subsampling_stats(cells: DataFrame, expr: DataFrame, plan: Plan, fractions: list[float], *args, **fit) -> DataFrame:
    """(fraction, slot, stat): the loss of all cells' model, slot 0, and of each fraction's subsets over the fraction."""
    s = subsampling(cells, expr, plan, fractions, *args, **fit)
    nulls = s.filter("variant > 0").select("fraction", F.col("variant").alias("slot"), F.col("loss").alias("stat"))
    truth = s.filter("variant = 0").select(F.explode(F.array(*(F.lit(float(x)) for x in fractions))).alias("fraction"), F.lit(0).alias("slot"), F.col("loss").alias("stat"))
    return truth.unionByName(nulls)


def compared_subsampling_stats(cells: DataFrame, expr: DataFrame, plan: Plan, fractions: list[float], draws: int, n_nulls: int, seed: int, metric: str, **fit) -> tuple[DataFrame, DataFrame]:
    """(fraction, slot, stat), mean losses on subsets, slot 0 with the true measurements and the others with permuted ones; and (fraction, correlation).

    correlation: mean rank correlation of a subset's depths with those of all cells' model.
    """
    masks = T.draw_masks(N.subset_masks(cells, fractions, draws, seed), fractions, draws)
    slots = with_permuted_rows(cells.select(F.lit(0).alias("slot"), "cell_id", "x", "y"), 0, n_nulls, seed + 100_000)
    t = T.fit_slots(slots, cells, expr, plan, masks=masks, **fit)
    stats = T.statistics(t, metric).filter("variant > 0").groupBy(delta_of("variant", fractions, draws).alias("fraction"), "slot").agg(F.avg("stat").alias("stat"))
    own = t.depths().filter("slot = 0")
    base = own.filter("variant = 0").select("cell_id", F.col("depth").alias("base"))
    scores = T.similarity(own.filter("variant > 0 AND used").join(base, "cell_id"), ["variant"], "base", "spearman_corr_mean")
    return stats, scores.groupBy(delta_of("variant", fractions, draws).alias("fraction")).agg(F.avg("score").alias("correlation"))


def compared_subsampling(*args, **fit) -> DataFrame:
    """(fraction, stat_true, p_value, n_perms, correlation) of compared_subsampling_stats."""
    stats, alike = compared_subsampling_stats(*args, **fit)
    return permutation_p(stats, ["fraction"]).join(alike, "fraction")


GRADIENT = "gradient int, gene string, p_value double, q_value double, gradient_p double"


def recursive_svg(cells: DataFrame, expr: DataFrame, plan: Plan, n_perms: int, seed: int, alpha: float = 0.05, max_gradients: int = 10, metric: str = "nll_gaussian_mse", **fit) -> DataFrame:
    """Gradients one after another: test, call genes on the depth, take them out, repeat while p < alpha.

    gradient_p: the p-value of the gradient's own test. A gradient that calls no gene ends
    the search, as does one that leaves none.

    Layouts and measurements are packed by cell once; a later gradient reads that table
    without the called genes. reruns, by_type, covariate and masks are those of fit_slots.
    """
    found = cells.sparkSession.createDataFrame([], GRADIENT)
    expr = written(expr.select("cell_id", "gene", "value"), "expr")
    genes = gene_order(expr)
    reruns = fit.pop("reruns", 1)
    table = T.cell_table(N.coordinate_permutation(cells, n_perms, seed), cells, expr, plan, **fit)
    for g in range(1, max_gradients + 1):
        t = T.fit_table(table, plan, reruns)
        p = T.test(t, metric).first()["p_value"]
        if p >= alpha:
            break
        rows = t.with_depth().select("z", F.posexplode("a").alias("i", "value"))
        fits = D.with_f_p(D.quadratic_fit(rows, ["i"]), 2)
        tests = written(fits.select(F.get(F.array(*map(F.lit, genes)), "i").alias("gene"), "p_value"), "tests", 1)
        own = written(bh_qvalues(tests).filter(F.col("q_value") < alpha).select(F.lit(g).alias("gradient"), "gene", "p_value", "q_value", F.lit(float(p)).alias("gradient_p")), "called", 1)
        called = {r[0] for r in own.select("gene").collect()}  # a dimension
        if not called:
            break
        found = found.unionByName(own)
        kept = [gene not in called for gene in genes]
        if g == max_gradients or not any(kept):
            break
        table = T.narrowed(table, kept, plan, fit.get("by_type", False))
        genes = [gene for gene in genes if gene not in called]
    return found
